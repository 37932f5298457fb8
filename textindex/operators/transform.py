"""The Burrows-Wheeler transform and its auxiliary indexes as relations over a suffix array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import positions


def bwt(corpus: DataFrame, sa: DataFrame) -> DataFrame:
    """(doc_id, l_hex, primary_index): the last byte, then the byte before each suffix in rank order, the whole text's left out."""
    byte = F.hex(F.substring(F.col("bytes"), F.col("pos").cast("int") + 1, F.lit(1)))
    before = F.lag(byte).over(Window.partitionBy("doc_id").orderBy("pos"))
    last = F.last_value(byte).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the row of the whole text gives the last byte, at the front
    column = positions(corpus).select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.coalesce(before, last).alias("byte"))
    rows = sa.join(column, (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p")))
    place = F.when(F.col("pos") == 0, -1).otherwise(F.col("rank"))
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "byte"))).alias("rows"), F.max(F.when(F.col("pos") == 0, F.col("rank") + 1)).alias("primary_index"))
    return got.select("doc_id", F.array_join(F.transform("rows", lambda x: x["byte"]), "").alias("l_hex"), "primary_index")


def bwt_aux(sa: DataFrame, r: int) -> DataFrame:
    """(doc_id, k, i): the inverse suffix array at every r-th position plus one; r is a power of two, 2 or more."""
    if r < 2 or r & (r - 1):
        raise ValueError(f"the sampling rate must be a power of two of at least 2, not {r}")
    return sa.where(F.col("pos") % r == 0).select("doc_id", F.floor(F.col("pos") / r).cast("bigint").alias("k"), (F.col("rank") + 1).alias("i"))
