"""Previous and next smaller values of a suffix array as joins, and their text order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_join(sa: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, psv, nsv, psv_rank, nsv_rank) by an inequality self-join within each text: for short texts."""
    a = sa.select("doc_id", "rank", "pos")
    b = sa.select(F.col("doc_id").alias("d"), F.col("rank").alias("other"), F.col("pos").alias("at"))
    met = a.join(b, (F.col("doc_id") == F.col("d")) & (F.col("at") < F.col("pos")), "left")
    below, above = F.col("other") < F.col("rank"), F.col("other") > F.col("rank")
    return met.groupBy("doc_id", "rank", "pos").agg(
        F.max_by("at", F.when(below, F.col("other"))).alias("psv"),
        F.min_by("at", F.when(above, F.col("other"))).alias("nsv"),
        F.max(F.when(below, F.col("other"))).alias("psv_rank"),
        F.min(F.when(above, F.col("other"))).alias("nsv_rank"),
    )


def text_order(values: DataFrame, column: str) -> DataFrame:
    """(doc_id, pos, column): the same values by text position; the suffix array is the key's new name."""
    return values.select("doc_id", "pos", column)
