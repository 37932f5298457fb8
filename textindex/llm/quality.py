"""Quality rules: fixed base rules and gradient-boosted trees over document statistics.

The trees are grown on histogram bins with Newton steps of the logistic loss; a split on a
constrained feature must keep its children's values in order, and their bounds go down to
what grows below, so the score is monotonic in that feature. All trees together are flattened
to numpy arrays (feature, threshold, left, right, value), and a batch of documents walks down
one level at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, map_batches, shared_table, table, words

#: Labelled documents that the trees are fitted on, about: those with a low hash of the id.
SAMPLE = 6000
TREES, DEPTH, BINS, RATE, LAMBDA, LEAST_LEAF = 60, 3, 64, 0.15, 1.0, 8
#: A document is kept if its probability of good quality is at least this.
KEEP_FROM = 0.3
MIN_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: name -> sign of the constraint on the score (0: free)
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0, "alpha_word_share": 0, "end_marks": 0, "bars": -1, "words_a_line": 0, "distinct_share": 0}

_symbols = re.compile(rb"[#*$%&|<>]")


def repeat_words(ws: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(ws)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, n)
    if len(number) == n:
        return 0
    k = len(number)
    if k < 2_000_000:
        keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        keys = pairs[:-1].astype(np.int64) * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for d in range(3):
        inside[d : n - 2 + d] |= twice
    return int(inside.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of a whole text; null is the empty text."""
    ws = words(text)
    n = len(ws)
    if not n:
        return [0, 0, len(_symbols.findall(text.encode("utf-8", "surrogatepass"))) if text else 0, 0, 0], [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    bytes_in = sum(map(len, ws))
    chars = bytes_in - (len(raw) - len(text))  # white space between words is ASCII, one byte each
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(ws)
    ascii_count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(ascii_count[65:91].sum()), int(ascii_count[97:123].sum()), int(ascii_count[48:58].sum())
    marks = int(ascii_count[[33, 46, 63]].sum())
    high = sum(1 for w in ws if w[-1:].isalpha() or w[-1] > 127)
    return [n, chars, symbols, dup, repeats], [np.log1p(n), chars / n, symbols / n, dup / max(1, len(lines)), repeats / n, upper / max(1, upper + lower), digits / n, high / n, marks / n, int(ascii_count[124]) / n, n / max(1, len(lines)), len(set(ws)) / n]


class Forest:
    """Flattened trees: node k goes to left[k] if x[feature[k]] <= threshold[k], else to right[k]; leaves point to themselves."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth: int):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = feature, threshold, left, right, value, roots

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE, lam=LAMBDA, least=LEAST_LEAF) -> Forest:
    """Boosted trees of 0/1 labels; without two classes the score is constant."""
    rows = ([], [], [], [], [])

    def node(f=0, t=np.inf, v=0.0) -> int:
        k = len(rows[0])
        for store, z in zip(rows, (f, t, k, k, v), strict=True):
            store.append(z)
        return k

    roots = []
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share))) if len(y) else 4.0
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), base)

        def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            worth = lambda gg, hh: np.clip(-gg / (hh + lam), low, high)
            gain = lambda gg, hh, v: -(gg * v + 0.5 * (hh + lam) * v * v)
            gs, hs = g[at].sum(), h[at].sum()
            v = float(worth(gs, hs))
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth and len(at) >= 2 * least:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[at, j]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
                    vl, vr = worth(gl, hl), worth(gs - gl, hs - hl)
                    won = gain(gl, hl, vl) + gain(gs - gl, hs - hl, vr) - gain(gs, hs, v)
                    ok = (nl >= least) & (len(at) - nl >= least) & (signs[j] * (vr - vl) >= 0)
                    won = np.where(ok, won, -1)
                    k = int(won.argmax())
                    if won[k] > best[0]:
                        best = (float(won[k]), j, k, float(vl[k]), float(vr[k]))
            _, j, k, vl, vr = best
            me = node(v=v * rate)
            if j >= 0:
                goes = binned[at, j] <= k
                mid = (vl + vr) / 2
                bounds = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
                rows[0][me], rows[1][me] = j, float(cuts[j][k])
                rows[2][me] = grow(at[goes], g, h, level + 1, *bounds[0])
                rows[3][me] = grow(at[~goes], g, h, level + 1, *bounds[1])
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
            one = Forest(0.0, *(np.array(r) for r in rows), np.array(roots[-1:]), depth)
            q = one.score(x)
            total += np.log(q / (1 - q))
    else:
        roots.append(node())
    return Forest(base, *(np.array(r) for r in rows), np.array(roots), depth)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the features as an array, for each row of docs."""

    def each(batch: pa.RecordBatch) -> dict:
        made = [statistics(x) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {k: [m[0][i] for m in made] for i, k in enumerate(BASE)} | {"features": [m[1] for m in made]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, " + ", ".join(f"{k} bigint" for k in BASE) + ", features array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on about `sample` labelled documents, one for each id.

    Rows with a null id, quality or text don't count; of several labels of an id the lowest does, of several texts the least.
    Only the sampled labels go to the driver, and only the statistics of their documents; without any the score is constant.
    """
    some = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = shared_table(hash_sample(some.groupBy("doc_id").agg(F.min("quality").alias("quality")), sample), "labels")
    chosen = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id")  # about `sample` ids
    got = measure(chosen.groupBy("doc_id").agg(F.min("text").alias("text"))).select("doc_id", "features").toPandas()
    quality = {r["doc_id"]: r["quality"] for r in some.collect()}
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["features"].tolist(), float).reshape(len(got), len(FEATURES))
    y = np.array([quality[i] for i in got["doc_id"]], float)
    return fit(x, y, np.array(list(FEATURES.values())))


def judge(docs: DataFrame, forest: Forest, keep_from: float = KEEP_FROM, min_words: int = MIN_WORDS, columns: list[str] | None = None) -> DataFrame:
    """docs' id (or `columns`) with the base counts, base_failed, quality_score and kept, row for row.

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike, null ids pass through. Texts are
    read whole, however long; an empty table gives no rows. Columns of docs that aren't asked for aren't read, whatever their names.
    """
    columns = columns or ["doc_id"]
    docs = docs.select(*columns, F.col("text").alias("__text"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[:-1])

    def each(batch: pa.RecordBatch) -> dict:
        made = [statistics(x) for x in batch.column(len(columns)).to_pylist()]
        base = np.array([m[0] for m in made], np.int64).reshape(len(made), len(BASE))
        score = forest.score(np.array([m[1] for m in made], float))
        failed = (base[:, 0] < min_words) | (100 * base[:, 4] > 50 * base[:, 0])
        out = {c: batch.column(i) for i, c in enumerate(columns)} | {k: base[:, i] for i, k in enumerate(BASE)}
        return out | {"base_failed": failed, "quality_score": score, "kept": ~failed & (score >= keep_from)}

    return map_batches(docs, each, spec + ", " + ", ".join(f"{k} bigint" for k in BASE) + ", base_failed boolean, quality_score double, kept boolean")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns (as they are, whatever their names)."""
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*inner.values()).withColumn("text", F.col(inner["text"]))
    out = judge(renamed, train(docs, labels), columns=list(inner.values())).where("kept")
    return out.select(*[F.col(v).alias(k) for k, v in inner.items()])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6's result SQL can express."""
    return op6_quality(spark, sf_dir).select("doc_id", *BASE, "base_failed")


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM s, range(3) z(k) GROUP BY doc_id),
b AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM t LEFT JOIN r ON r.doc_id = t.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
"""
