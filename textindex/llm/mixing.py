"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are sorted by that key:
ranges of the key (buckets) are sorted apart from each other, the bucket totals are summed to
offsets, and offset plus running sum is the number of words before a document. The source's
budget is cut there to the word; a budget above the source's size first takes whole epochs.

Only DataFrame functions are used. No source, however large, meets in one task: the sort works
on (source, bucket), and only bucket totals meet by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, row_hash, shared_table, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Ranges of keys that each source is cut to.
ROWS_A_BUCKET, LEAST_BUCKETS = 20_000, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> (source, source_size, target); one row a source.

    Sources in code point order, null last, weigh `weights` in turn. Together they get `share`
    of all sizes; no source gets more than `most` times its size, what it leaves goes to the
    others by weight. That fills the sources in the order of cap / weight: those in front are
    capped, all others get one level times their weight.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("all", F.sum("source_size").over(Window.partitionBy()) * share)
    t = t.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the level of the first source that is not capped holds for all behind it
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("held", F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return t.select("source", "source_size", F.coalesce(F.col("held") * F.col("w"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, size: str = "size", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, prefix: str = "") -> DataFrame:
    """docs with source_size, target and taken: the words of each document that the mix takes.

    The key is a hash of id and size, so rows without an id or that repeat one don't meet in one range of keys. Repeated rows
    are documents of their own; ties go by the hash of the whole row (equal rows are interchangeable). A null source is a source,
    null or zero sizes take nothing, and a size may be as large as a long text has it. An empty table gives no rows. The new
    columns have `prefix` in front; columns of docs of the same names are replaced, so choose one that docs doesn't have.
    """
    new = {k: f"{prefix}{k}" for k in ("source_size", "target", "taken")}
    docs = docs.drop(*new.values())
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    d = docs.toDF(*inner.values())
    own = {"__source": F.col(inner[source]), "__size": F.coalesce(F.col(inner[size]), F.lit(0)).cast("bigint"), "__row": row_hash(d)}
    d = d.withColumns(own)
    buckets = max(LEAST_BUCKETS, docs.select(source).count() // ROWS_A_BUCKET)
    d = d.withColumn("__key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(inner[doc_id]).cast("string"), F.lit("")), F.lit(":"), F.col("__size").cast("string")).cast("binary")))
    d = d.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * buckets / 2**32).cast("int"))
    sums = d.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum"))
    run = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__offset", F.sum("__sum").over(run) - F.col("__sum"))
    sums = shared_table(sums, "mix-buckets")
    goal = targets(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("__sum").alias("source_size")), weights, share, most)
    goal = goal.select(F.col("source").alias("__s"), F.col("source_size").alias("__all"), F.col("target").alias("__target"))
    sums = sums.join(goal, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s", "__sum")
    sums = sums.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__offset", "__all", "__target")

    within = Window.partitionBy("__source", "__bucket").orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__before", F.sum("__size").over(within) - F.col("__size"))
    d = d.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    epochs = F.when(F.col("__all") > 0, F.floor(F.col("__target") / F.col("__all"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.floor(F.col("__target") - epochs * F.col("__all")).cast("bigint")
    cut = F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__offset") - F.col("__before")))
    taken = (epochs * F.col("__size") + cut).cast("bigint")
    return d.select(*[F.col(v).alias(k) for k, v in inner.items()], F.col("__all").alias(new["source_size"]), F.col("__target").alias(new["target"]), taken.alias(new["taken"]))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = shared_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)) AS k
  FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
w AS (SELECT source, n, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
             2.0::DOUBLE * n AS cap, sum(n) OVER () * 1.5::DOUBLE AS al FROM s),
l AS (SELECT *, (al - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
h AS (SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS)
             OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM l),
t AS (SELECT source, n, coalesce(held * w, cap) AS target, CASE WHEN n > 0 THEN floor(coalesce(held * w, cap) / n) ELSE 0 END AS e FROM h),
p AS (SELECT d.*, n, target, e, sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
       CAST(e * size + greatest(0, least(size, floor(target - e * n) - before)) AS BIGINT) AS taken
FROM p
"""
