"""Document fingerprints by winnowing.

Every K code points in a row have a polynomial hash. Of every WINDOW hashes in a row the least
is chosen, of equal ones the rightmost, and its position is kept. Two texts that share
K + WINDOW - 1 code points in a row share a fingerprint; no shared run below K gives one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import range_bounds, range_of, table

K = 12
WINDOW = 24
BYTES_A_RANGE = 24_000_000
#: Code points of a long text that are worked on at once.
STEP = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _powers(n: int) -> dict[int, np.uint64]:
    return {m: np.uint64(pow(int(_B), m, 1 << 64)) for m in range(n + 1)}


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32 mixed bits of the polynomial hash of each k-gram (fewer codes than k: of all as one)."""
    k = min(k, len(codes))
    power = _powers(k)
    part, have = codes.astype(np.uint64), 1  # part: hashes of `have` codes in a row
    total, done = None, 0
    while True:
        if k & have:
            total = part if total is None else total[: len(part) - done] * power[have] + part[done:]
            done += have
        if done == k:
            break
        part = part[:-have] * power[have] + part[have:]
        have *= 2
    h = total
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return (h ^ (h >> np.uint64(31))) >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending) and hashes of the text's fingerprint; the empty text has none."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    chosen = []
    for start in range(0, max(1, len(codes) - k - window + 2), STEP):
        h = gram_hashes(codes[start : start + STEP + k + window - 2], k)
        key = h << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(start, start + len(h), dtype=np.uint64)
        span = 1  # key: the least of `span` in a row
        least = key
        want = min(window, len(key))
        while 2 * span <= want:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < want:
            least = np.minimum(least[: len(key) - want + 1], least[want - span :])
        chosen.append(least[np.append(True, least[1:] != least[:-1])])
    key = np.unique(np.concatenate(chosen))
    at = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    order = np.argsort(at)
    return at[order], (key >> np.uint64(32))[order]


def written(at: np.ndarray, hashes: np.ndarray) -> str:
    """position:hash, by position, one blank between."""
    return " ".join([f"{p}:{h:08x}" for p, h in zip(at.tolist(), hashes.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' sets of hashes; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs (doc_id, text) dealt by ranges of doc_id: to (range), copy, doc_id, text.

    Each partition is sorted by range, and after a range's own rows comes the first row of the next
    range (copy = 1; after the last range the first of all), so one pass sees every row's successor.
    The texts are shuffled once. Null ids come first; rows that repeat an id are in order of their texts' hashes, and
    where they are many they are several ranges.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        parts = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BYTES_A_RANGE + 1
    bounds = range_bounds(docs, "doc_id", parts)
    ranged = docs.withColumn("tie", F.xxhash64("text")).withColumn("range", range_of("doc_id", bounds, "tie"))
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")
    firsts = ranged.groupBy("range").agg(F.min(own).alias("first")).orderBy("range").collect()  # a row for each range
    # by range: its first row's id (or none) and hash, and the range before
    known, ids, ties, to = np.zeros(len(bounds) + 1, bool), np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int32)
    for i, r in enumerate(firsts):
        k = r["range"]
        known[k], ids[k], ties[k], to[k] = r["first"]["known"], r["first"]["doc_id"] or 0, r["first"]["tie"], firsts[i - 1]["range"]

    @F.pandas_udf("int")
    def also(some: pd.Series, key: pd.Series, tie: pd.Series, place: pd.Series) -> pd.Series:
        """The range before, for the first row of a range and its copies."""
        k = place.to_numpy()
        return pd.Series(np.where((some.to_numpy() == known[k]) & (key.to_numpy() == ids[k]) & (tie.to_numpy() == ties[k]), to[k], -1).astype("int32"))

    one = F.struct(F.col("range").alias("to"), F.lit(0).alias("copy"))
    two = F.struct(F.col("also").alias("to"), F.lit(1).alias("copy"))
    dealt = ranged.withColumn("also", also(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "tie", "range")).withColumn("place", F.explode(F.when(F.col("also") >= 0, F.array(one, two)).otherwise(F.array(one))))
    dealt = dealt.select("place.to", "place.copy", "doc_id", "text", "tie")
    dealt = dealt.repartitionById(len(bounds) + 1, "to").sortWithinPartitions("to", "copy", F.col("doc_id").asc_nulls_first(), "tie", "text")
    return dealt.drop("tie")


def fingerprint_pairs(docs: DataFrame, parts: int | None = None, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: its fingerprint, that of its edited text, and both likenesses.

    A null text is the empty text, whose fingerprint is the empty string; two empty fingerprints have likeness 1.
    A text shorter than a gram is one gram. Rows that repeat an id are rows of their own, each the other's
    successor. A single row is its own successor. No rows: none out. Texts are read whole, however long. Other columns,
    clashing names too, aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done = None, None  # (range, doc_id, text, fingerprint) that lacks its successor; range that has met its copy
        rows: list[tuple] = []

        def pair(one, text: str, mark) -> tuple:
            _, doc_id, own, (at, hashes) = one
            other = edited(own, text)
            e_at, e_hashes = winnow(other, k, window)
            return (doc_id, len(own), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(at, hashes), written(e_at, e_hashes), likeness(hashes, e_hashes), likeness(hashes, mark[1]))

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[x.split()[0] for x in SCHEMA.split(", ")])
            rows.clear()
            return made

        for batch in batches:
            to, copy, ids = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(batch.column(3)):
                if copy[i] and done == to[i]:
                    continue
                text = text.as_py()
                mark = winnow(text, k, window)
                if waiting:
                    rows.append(pair(waiting, text, mark))
                waiting, done = (None, to[i]) if copy[i] else ((to[i], ids[i], text, mark), None)
                if len(rows) >= 500:
                    yield out()
        if rows:
            yield out()

    return with_next(docs, parts).mapInArrow(run, SCHEMA)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op3's result SQL can express."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS f FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(t[:n - n // 2] || CASE WHEN n // 2 > 0 THEN f[:n // 2] ELSE '' END) AS edited_sha256 FROM n
"""
