"""A training corpus from documents, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.bpe import digests
from textindex.llm.common import WORD, shared_table, table
from textindex.llm.jaccard import one_of_each
from textindex.llm.lines import dedup
from textindex.llm.mixing import mix, word_count
from textindex.llm.quality import filter_quality


# Of every stage: the columns of docs come out as they were, whatever their names, but for text and n_chars where a stage cuts
# texts. Ids may be null or repeat; rows that repeat are rows of their own unless said otherwise. Texts are read whole,
# however long. An empty table comes out empty.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.

    A null or empty text fails the base rules. Rows that repeat are judged alike; without labels the trees reject none.
    """
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose text or template recurs across documents go, but for their first document; a document that loses every word goes too.

    The first document is that of the smallest id (null last), of equal ids that of the least hash. Rows that repeat id and text
    are one document and end up alike. A null text stays null. n_chars, where docs has it, is set to the new length.
    """
    out = dedup(docs, "__n_lines", "__n_dropped")
    lost = (F.col("__n_dropped") > 0) & (word_count(F.col("text")) == 0)
    out = out.where(~lost)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join over five-word shingles, at 80 percent, stays: that of the smallest id
    (null last), of equal ids that of the least hash. Documents without words all stay."""
    return one_of_each(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document comes as often as whole epochs take it, and where a source's
    budget ends inside a document, that one comes once more, cut to the words that the budget has left.

    A null source is a source. Documents without words, null texts too, take nothing and go. Ties of the order go by the hash of the row.
    """
    out = mix(docs.withColumn("__words", word_count(F.col("text"))), size="__words", prefix="__")
    whole = F.when(F.col("__words") > 0, F.floor(F.col("__taken") / F.col("__words"))).otherwise(F.lit(0)).cast("int")
    rest = (F.col("__taken") - whole * F.col("__words")).cast("int")
    copies = F.when(whole > 0, F.array_repeat(F.lit(-1), whole)).otherwise(F.array().cast("array<int>"))
    copies = F.concat(copies, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("__take", F.explode(copies))
    part = F.when(F.col("__take") < 0, F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("__take"), F.lit(1))), " "))
    out = out.withColumn("text", part)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__take") < 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each document of the mixture,
    repeats included. A null text has no ids."""
    # the workers hold what earlier stages left as well, so they keep and work on less at once than for the operator alone
    return digests(docs, keep_ids=True, keep=12 << 20, batch_bytes=1_000_000)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixture", mixture), ("encoded", encoded)]

#: SQL can express neither the trees nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}", spark)
    return STAGES[-1][1](spark, docs, sf_dir)
