"""Texts as a table: one row (doc_id, bytes) a text. Order and positions are those of bytes, not of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_table


def from_strings(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, bytes) from a string column, in UTF-8; rows without a text are left out."""
    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("bytes"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One text for each file of a folder or glob: doc_id (in the order of paths), path, bytes.

    Paths are sorted by ranges and numbered in a shared table; neither they nor contents go to the driver, only a count
    for each range. Spark has no row for an empty file.
    """
    files = spark.read.format("binaryFile").load(path)
    ranged = files.select("path").repartitionByRange("path").sortWithinPartitions("path")

    def number(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int64()), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column(0)], names=["part", "n", "path"])
            n += batch.num_rows

    numbered = shared_table(ranged.mapInArrow(number, "part bigint, n bigint, path string"), "file-numbers", spark)
    upto, before = 0, []
    for r in sorted(numbered.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before.append((r["part"], upto))
        upto += r["n"]
    ids = numbered.join(F.broadcast(spark.createDataFrame(before, "p bigint, before bigint")), F.col("part") == F.col("p"))
    return files.select("path", F.col("content").alias("bytes")).join(ids.select((F.col("before") + F.col("n")).alias("doc_id"), "path"), "path").select("doc_id", "path", "bytes")


def positions(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, bytes) for every position; empty texts have none."""
    filled = corpus.where(F.octet_length("bytes") > 0)
    return filled.select("doc_id", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes").cast("bigint") - 1)).alias("pos"))


#: Positions that one row of a long text spans before they become rows of their own.
CHUNK = 1 << 16


def prefixes(corpus: DataFrame, width: int, spread: bool = False) -> DataFrame:
    """(doc_id, pos, key) for every position: key is the `width` bytes from there on, fewer at the end.

    A text is cut to chunks first, so no row holds more than a chunk besides its keys; with `spread` the chunks are dealt over
    all tasks, for texts that are few and large.
    """
    size = F.octet_length("bytes").cast("bigint")
    cut = corpus.where(size > 0).select("doc_id", "bytes", size.alias("n"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(CHUNK).cast("bigint"))).alias("first"))
    cut = cut.select("doc_id", "n", "first", F.substring(F.col("bytes"), F.col("first").cast("int") + 1, F.lit(CHUNK + width - 1)).alias("chunk"))
    if spread:
        cut = cut.repartition("doc_id", "first")
    at = cut.select("doc_id", "first", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(CHUNK), F.col("n") - F.col("first")) - 1)).alias("at"))
    return at.select("doc_id", (F.col("first") + F.col("at")).alias("pos"), F.substring(F.col("chunk"), F.col("at").cast("int") + 1, F.lit(width)).alias("key"))


def symbols(corpus: DataFrame, spread: bool = False) -> DataFrame:
    """(doc_id, pos, byte)."""
    return prefixes(corpus, 1, spread).select("doc_id", "pos", F.conv(F.hex("key"), 16, 10).cast("bigint").alias("byte"))


def byte_counts(corpus: DataFrame) -> DataFrame:
    """(byte, n): how often each byte value stands in all texts; counted in the tasks, 256 rows of each are summed."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in rows:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_py() or b"", np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["byte", "n"])

    return corpus.select("bytes").mapInArrow(run, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n"))
