"""Line dedup by a tree of log templates.

A line's words go down a tree of fixed depth: first their number, then the leading words, where a word
with a digit is a variable field. Lines with too few other words for a template, such as rows of numbers,
stay out of the tree and are compared as they are, digits and all. Lines of one leaf form templates:
CONSTANT percent of a template's words are constant, so no template of a line has more documents than the
leaf has for the last of so many of the line's words, the commonest at their places first. The words that
reach LIKE percent of that number, and TEMPLATE_DOCS documents, are constant; the other fields are variable,
however many documents each of their values has. A line goes if it recurs in another document (but for
fields with digits, 100 - CONSTANT percent of its words at most), or if its template does in TEMPLATE_DOCS,
and the document isn't the first that has it; so what is lost is the values of fields.

All counts are over all documents and by sums that start on the map side: no leaf, template
or line, however common, meets in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import releasing, shared_table, table
from .jaccard import FILTER_BITS, _filter_of

#: Leading words that the tree looks at, below the number of words.
DEPTH = 3
#: Shorter lines (in words) are left alone; templates need more than lines that recur as they are.
LEAST_WORDS, TEMPLATE_WORDS = 4, 6
LINE_DOCS, TEMPLATE_DOCS = 2, 5
#: Percent of a template's words that are constant, at least.
CONSTANT = 70
#: A constant word has at least so many percent of the documents that the last needed one has.
LIKE = 80
VARIABLE = b"<*>"

_digit = re.compile(rb"[0-9]").search


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parse(line: bytes) -> tuple[int, int, list[bytes]] | None:
    """(line id, leaf id, words with variable fields) or None for a line that is left alone; no words for one that is compared as it is."""
    ws = line.split()
    if len(ws) < LEAST_WORDS:
        return None
    if _digit(line):
        masked = [VARIABLE if _digit(w) else w for w in ws]
        if 100 * (len(ws) - masked.count(VARIABLE)) < CONSTANT * len(ws):
            return _signed(xxhash.xxh3_64_intdigest(b" ".join(ws), seed=3)), 0, []
        ws = masked
    lead = b"%d %s" % (len(ws), b" ".join(ws[:DEPTH]))
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(ws))), _signed(xxhash.xxh3_64_intdigest(lead, seed=2)), ws


def document_key(doc_id: int | None, raw: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(raw, seed=0 if doc_id is None else (doc_id & 0x7FFFFFFFFFFFFFFF) + 1))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, line, leaf, words): each line of each document once, read from a shared table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                key, seen = document_key(doc_id, raw), set()
                for x in raw.split(b"\n"):
                    if (p := parse(x)) and p[0] not in seen:
                        seen.add(p[0])
                        rows.append((key, doc_id, p[0], p[1], len(p[2])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc", "doc_id", "line", "leaf", "words"])

    return shared_table(docs.select("doc_id", "text").mapInArrow(releasing(run), "doc bigint, doc_id bigint, line bigint, leaf bigint, words bigint").distinct(), "lines")


def _fields(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(line, leaf, fixed, fields): the number of leading words without digits and hashes of the words behind (null for one with a digit), for lines of these leaves (and the filter's false hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(leaves.select(F.col("leaf").alias("node"))))  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            line, leaf, fixed, flat, ends = [], [], [], [], [0]
            for text in batch.column(0):
                for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n"):
                    if (p := parse(x)) and len(p[2]) >= TEMPLATE_WORDS and p[0] not in seen and bits[(k := p[1] % FILTER_BITS) >> 3] >> (7 - (k & 7)) & 1:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(p[0])
                        line.append(p[0])
                        leaf.append(p[1])
                        fixed.append(DEPTH - p[2][:DEPTH].count(VARIABLE))
                        flat.extend([None if w == VARIABLE else _signed(xxhash.xxh3_64_intdigest(w)) for w in p[2][DEPTH:]])
                        ends.append(len(flat))
            fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(leaf, pa.int64()), pa.array(fixed, pa.int32()), fields], names=["line", "leaf", "fixed", "fields"])

    return docs.select("text").mapInArrow(releasing(run), "line bigint, leaf bigint, fixed int, fields array<bigint>")


def templates(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(line, template) of the lines whose template has enough constant words; seen: occurrences(docs)."""
    leaves = seen.where(F.col("words") >= TEMPLATE_WORDS).groupBy("leaf").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high"))
    leaves = shared_table(leaves.where((F.col("n") >= TEMPLATE_DOCS) & (F.col("low") != F.col("high"))).select("leaf"), "leaves")
    many = shared_table(seen.groupBy("line").agg(F.count("*").alias("docs")).withColumnRenamed("line", "l"), "line-counts")
    fields = _fields(docs, leaves).groupBy("line").agg(F.any_value("leaf").alias("leaf"), F.any_value("fixed").alias("fixed"), F.any_value("fields").alias("fields"))
    fields = shared_table(fields.join(many, F.col("line") == F.col("l")).select("line", "leaf", "docs", "fixed", "fields"), "fields")
    cells = fields.select("line", "leaf", "docs", F.posexplode("fields").alias("place", "word")).where("word is not null")
    common = cells.groupBy("leaf", "place", "word").agg(F.sum("docs").alias("n")).where(F.col("n") >= TEMPLATE_DOCS)
    common = shared_table(common.select(F.col("leaf").alias("a"), F.col("place").alias("b"), F.col("word").alias("c"), "n"), "constants")
    held = cells.join(common, (F.col("leaf") == F.col("a")) & (F.col("place") == F.col("b")) & (F.col("word") == F.col("c")))
    made = held.groupBy("line", "leaf").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("held"))  # a line's own words at most
    need = F.floor((CONSTANT * (F.size("fields") + DEPTH) + 99) / 100).cast("int") - F.col("fixed")
    made = made.join(fields.select(F.col("line").alias("l"), need.alias("need")), F.col("line") == F.col("l")).where(F.size("held") >= F.col("need"))
    made = made.withColumn("least", F.get(F.sort_array("held.n", asc=False), F.col("need") - 1))
    kept = F.transform(F.filter("held", lambda x: 100 * x["n"] >= LIKE * F.col("least")), lambda x: F.struct(x["place"], x["word"]))
    made = made.withColumn("kept", kept)
    return shared_table(made.select("line", F.xxhash64("leaf", "kept").alias("template")), "templates")


def dropped(docs: DataFrame) -> DataFrame:
    """(doc, lines): for each document that loses any, the ids of the lines it loses."""
    seen = occurrences(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc")).alias("first")
    plain = seen.groupBy("line").agg(F.count("*").alias("n"), first).where(F.col("n") >= LINE_DOCS)
    plain = shared_table(plain.select(F.col("line").alias("l"), F.col("first.doc").alias("first")), "recurring-lines")
    gone = seen.join(plain, F.col("line") == F.col("l")).where("doc <> first").select("doc", "line")

    of = seen.join(templates(docs, seen).withColumnRenamed("line", "l"), F.col("line") == F.col("l")).select("doc", "doc_id", "line", "template")
    of = shared_table(of, "templated")
    once = of.select("doc", "doc_id", "template").distinct()
    common = once.groupBy("template").agg(F.count("*").alias("n"), first).where(F.col("n") >= TEMPLATE_DOCS)
    common = shared_table(common.select(F.col("template").alias("t"), F.col("first.doc").alias("first")), "recurring-templates")
    gone = gone.union(of.join(common, F.col("template") == F.col("t")).where("doc <> first").select("doc", "line"))
    return gone.groupBy("doc").agg(F.collect_set("line").alias("lines"))  # a document's own lines at most


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs' columns, the text without the lines that go, then n_lines and n_dropped (both long), row for row.

    A null text stays null with no lines; blank lines and lines of fewer than LEAST_WORDS words stay. Within a
    document repeated lines count once and go together. Rows that repeat id and text are one document and end up alike; rows that
    only repeat the id are documents of their own. The first document of a line or template is that of
    the smallest id (null last). Texts are read whole, however long; an empty table gives no rows. Other columns pass through,
    whatever their names, but for those called as the two new ones, which are replaced: name the new ones otherwise to keep them.
    """
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = dropped(plain).withColumnRenamed("doc", "__doc")

    @F.pandas_udf("bigint")
    def key(ids: pd.Series, texts: pd.Series) -> pd.Series:
        null = ids.isna()
        return pd.Series([document_key(None if z else int(i), (t or "").encode("utf-8", "surrogatepass")) for i, t, z in zip(ids, texts, null, strict=True)], dtype="int64")

    d = docs.toDF(*inner.values())
    d = d.withColumn("__text", F.col(inner["text"]).cast("string")).withColumn("__key", key(F.col(inner["doc_id"]).cast("bigint"), F.col("__text")))
    d = d.join(gone, F.col("__key") == F.col("__doc"), "left").withColumn("__lines", F.coalesce("lines", F.array().cast("array<bigint>")))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def cut(texts: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = []
        for text, go in zip(texts, lines, strict=True):
            if text is None:
                out.append((None, 0, 0))
                continue
            raw = text.split("\n")
            go = set(go.tolist() if isinstance(go, np.ndarray) else go)
            kept = [x for x in raw if not ((p := parse(x.encode("utf-8", "surrogatepass"))) and p[0] in go)] if go else raw
            out.append(("\n".join(kept), len(raw), len(raw) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    d = d.withColumn("__cut", cut("__text", "__lines"))
    own = [F.col("__cut.text").alias(k) if k == "text" else F.col(v).alias(k) for k, v in inner.items() if k not in (n_lines, n_dropped)]
    return d.select(*own, F.col("__cut.n_lines").alias(n_lines), F.col("__cut.n_dropped").alias(n_dropped))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 for each document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
