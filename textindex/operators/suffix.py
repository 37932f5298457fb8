"""Suffix arrays as relations: the Catalyst-only forms, round by round, and the choice between all forms.

Suffixes compare by unsigned bytes and a proper prefix is smaller. Ranks count from 1 inside
the loops, so that 0 can stand for what lies past the end, and from 0 in results.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.store import shared_table
from ..sources.corpus import positions, prefixes, symbols
from . import local

#: Memory that indexing a byte of text takes inside a task, about (measured 143), and the share of a core's memory that it may take.
BYTES_A_BYTE, SHARE = 160, 0.5


def large_from(spark: SparkSession) -> int:
    """Texts above this many bytes are indexed by the distributed operators, others inside a task: by the memory that a
    core has outside the JVM's heap (spark.executor.pyspark.memory or the overhead), 1 GB where nothing is set on one machine."""
    conf, unit = spark.conf, {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}

    def size(text: str, plain: int) -> int:
        found = re.fullmatch(r"(\d+)([bkmgt]?)b?", text.strip().lower())
        return int(found[1]) * (unit[found[2]] if found[2] else plain)

    cores = max(1, int(conf.get("spark.executor.cores", "1")))
    own, over = conf.get("spark.executor.pyspark.memory", None), conf.get("spark.executor.memoryOverhead", None)
    if own or over:
        held = size(own or over, 1 << 20)
    elif spark.sparkContext.master.startswith("local"):
        held = cores << 30
    else:
        factor = float(conf.get("spark.executor.memoryOverheadFactor", "0.1"))
        held = max(384 << 20, int(factor * size(conf.get("spark.executor.memory", "1g"), 1 << 20)))
    return max(1 << 16, int(SHARE * held / cores) // BYTES_A_BYTE)


def _by_doc(*order):
    return Window.partitionBy("doc_id").orderBy(*order)


def naive(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, pos) by sorting the suffixes themselves: for short texts."""
    s = positions(corpus).withColumn("suffix", F.substring(F.col("bytes"), F.col("pos").cast("int") + 1, F.lit(2**31 - 1)))
    return s.select("doc_id", (F.row_number().over(_by_doc("suffix")) - 1).cast("bigint").alias("rank"), "pos")


def first_ranks(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, r): the byte plus one."""
    return symbols(corpus).select("doc_id", "pos", (F.col("byte") + 1).alias("r"))


def ahead(ranks: DataFrame, k: int) -> DataFrame:
    """With r2, the rank k positions on, 0 past the end."""
    return ranks.withColumn("r2", F.coalesce(F.lead("r", k).over(_by_doc("pos")), F.lit(0)).cast("bigint"))


def group_ids(pairs: DataFrame) -> DataFrame:
    """flag where (r, r2) differs from the row before in order, and the running sum of the flags."""
    order = _by_doc("r", "r2", "pos")
    pair = F.struct("r", "r2")
    flag = F.when(F.lag(pair).over(order).isNull() | (F.lag(pair).over(order) != pair), 1).otherwise(0).cast("bigint")
    flagged = pairs.withColumn("flag", flag)
    return flagged.withColumn("gid", F.sum("flag").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def doubled(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, r): dense ranks of (r, r2), one round of prefix doubling."""
    return pairs.select("doc_id", "pos", F.dense_rank().over(_by_doc("r", "r2")).cast("bigint").alias("r"))


def refined_rank() -> Column:
    """Of (doc_id, r, r2): the rank of the group's least member, groups sorted inside by r2 only."""
    inside = Window.partitionBy("doc_id", "r").orderBy("r2")
    return (F.col("r") + F.rank().over(inside) - 1).cast("bigint")


def refined(pairs: DataFrame) -> DataFrame:
    """(doc_id, pos, r) with refined_rank()."""
    return pairs.select("doc_id", "pos", refined_rank().alias("r"))


def prefix_ranks(corpus: DataFrame, width: int = 8) -> DataFrame:
    """(doc_id, pos, rank0): how many suffixes have a smaller prefix of `width` bytes."""
    return prefixes(corpus, width).select("doc_id", "pos", (F.rank().over(_by_doc("key")) - 1).cast("bigint").alias("rank0"))


def tied(ranks: DataFrame) -> DataFrame:
    """The rows whose rank another position of the text shares."""
    return ranks.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "r"))).where("n > 1").drop("n")


def _rounds(corpus: DataFrame) -> int:
    longest = corpus.agg(F.max(F.octet_length("bytes"))).first()[0] or 0
    return max(1, int(longest).bit_length()) + 1


def doubling(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, pos) by prefix doubling; texts leave the loop when all their ranks differ. Each round is written to the shared folder."""
    ranks = first_ranks(corpus)
    done, k = None, 1
    for i in range(_rounds(corpus) + 1):
        ranks = doubled(ahead(ranks, k)) if i else doubled(ranks.withColumn("r2", F.lit(0).cast("bigint")))
        over = F.max("r").over(Window.partitionBy("doc_id")) == F.count("*").over(Window.partitionBy("doc_id"))
        marked = shared_table(ranks.withColumn("over", over), "doubling")
        finished, ranks = marked.where("over").drop("over"), marked.where("not over").drop("over")
        done = finished if done is None else done.union(finished)
        if ranks.isEmpty():
            return done.select("doc_id", (F.col("r") - 1).alias("rank"), "pos")
        k = k * 2 if i else 1
    raise RuntimeError("prefix doubling did not settle")


def doubling_rounds(corpus: DataFrame) -> DataFrame:
    """(doc_id, rounds): how often a text's prefix length doubles from 1 until all suffixes differ."""
    out, ranks, k = None, doubled(first_ranks(corpus).withColumn("r2", F.lit(0).cast("bigint"))), 1
    for i in range(_rounds(corpus) + 1):
        marked = shared_table(ranks.withColumn("over", F.max("r").over(Window.partitionBy("doc_id")) == F.count("*").over(Window.partitionBy("doc_id"))), "rounds")
        ended = marked.where("over").select("doc_id", F.lit(i).cast("bigint").alias("rounds")).distinct()
        out = ended if out is None else out.union(ended)
        rest = marked.where("not over").drop("over")
        if rest.isEmpty():
            return out
        ranks, k = doubled(ahead(rest, k)), k * 2
    raise RuntimeError("prefix doubling did not settle")


def fast(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, pos) from eight-byte prefixes on, sorting inside unresolved groups only.

    No window holds a whole text: the first sort works by the first two bytes (their counts, 65,792 at
    most a text, are summed to offsets), later ones by group of equal rank; the rank k positions on comes from an
    equi-join. So one very large text spreads over all tasks. Each round is written to the shared folder.
    """
    keyed = prefixes(corpus, 8, spread=True).withColumn("two", F.substring("key", 1, 2))
    heads = keyed.groupBy("doc_id", "two").agg(F.count("*").alias("n"))
    run = _by_doc("two").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select(F.col("doc_id").alias("d"), F.col("two").alias("t"), (F.sum("n").over(run) - F.col("n")).alias("before"))
    ranked = keyed.withColumn("own", F.rank().over(Window.partitionBy("doc_id", "two").orderBy("key")))
    ranked = ranked.join(heads, (F.col("doc_id") == F.col("d")) & (F.col("two") == F.col("t")))
    ranks = shared_table(ranked.select("doc_id", "pos", (F.col("before") + F.col("own")).cast("bigint").alias("r")), "fast")
    k = 8
    for _ in range(_rounds(corpus) + 1):
        open_ = shared_table(tied(ranks), "fast-open")
        if open_.isEmpty():
            return ranks.select("doc_id", (F.col("r") - 1).alias("rank"), "pos")
        there = ranks.select(F.col("doc_id").alias("d"), (F.col("pos") - k).alias("p"), F.col("r").alias("next"))
        pairs = open_.join(there, (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p")), "left").select("doc_id", "pos", "r", F.coalesce("next", F.lit(0)).cast("bigint").alias("r2"))
        new = refined(pairs).select(F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.col("r").alias("next"))
        ranks = ranks.join(new, (F.col("doc_id") == F.col("d")) & (F.col("pos") == F.col("p")), "left").select("doc_id", "pos", F.coalesce("next", "r").alias("r"))
        ranks = shared_table(ranks, "fast")
        k *= 2
    raise RuntimeError("the refinement did not settle")


def by_size(corpus: DataFrame, small: Callable[[DataFrame], DataFrame], big: Callable[[DataFrame], DataFrame], large: int | None = None) -> DataFrame:
    """small(texts up to `large` bytes) and, if there are larger ones, big(those); large_from() gives the bound where none is given."""
    large = large_from(corpus.sparkSession) if large is None else large
    size = F.octet_length("bytes")
    over = corpus.where(size > large)
    done = small(corpus.where(size <= large))
    return done if over.isEmpty() else done.unionByName(big(over))


def suffix_array(corpus: DataFrame, strategy: str = "auto", large: int | None = None) -> DataFrame:
    """(doc_id, rank, pos) of every text that isn't empty.

    auto: texts up to `large` bytes inside tasks, without a shuffle; larger ones by the distributed loop, if there are any.
    """
    forms = {"naive": naive, "doubling": doubling, "fast": fast, "local": local.sa_isa}
    if strategy in forms:
        return forms[strategy](corpus)
    if strategy != "auto":
        raise ValueError(f"no such strategy: {strategy}")
    return by_size(corpus, local.sa_isa, fast, large)


def head(sa: DataFrame, k: int = 5) -> DataFrame:
    """The first k ranks of each text."""
    return sa.where(F.col("rank") < k)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, match): whether two suffix arrays are equal, text by text; a text that only one has doesn't match."""
    left = a.select("doc_id", "rank", "pos", F.lit(1).alias("side"))
    both = left.union(b.select("doc_id", "rank", "pos", F.lit(2).alias("side")))
    rows = both.groupBy("doc_id", "rank", "pos").agg((F.sum("side") == 3).alias("ok"))
    return rows.groupBy("doc_id").agg(F.min("ok").alias("match"))


def verify(corpus: DataFrame, large: int | None = None) -> DataFrame:
    """(doc_id, match) for every text that isn't empty: whether two suffix arrays of it, made by two methods, are equal.

    Texts up to `large` bytes are indexed and compared inside tasks, without a row for each position; larger ones by fast(), compared with local.
    """
    return by_size(corpus, local.sa_match, lambda x: compare(fast(x), local.sa_isa(x)), large)
