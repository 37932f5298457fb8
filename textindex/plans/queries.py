"""The queries of the index operators over whole tables, and the same results in DuckDB's SQL.

Relations by position come from `part` (names) and `benchmark` (passages), where SQL can sort
whole suffixes; `documents` goes through the same operators, with round trips and summaries that SQL can check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import count_pattern, longest_repeat, match_length, register_lz77
from ..operators import large, local, neighbours, suffix, transform
from ..sources import corpus
from ..sources.corpus import from_strings, symbols
from .store import spread

PATTERN = b"th"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_strings(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_name")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_strings(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


# -- DuckDB: tables of positions, suffixes, ranks and neighbours ----------------------------------

_TEXTS = {
    "part": "SELECT CAST(p_partkey AS BIGINT) AS doc_id, hex(encode(p_name)) AS h FROM part",
    "benchmark": "SELECT CAST(item_id AS BIGINT) AS doc_id, hex(encode(text)) AS h FROM benchmark",
    "documents": "SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(text)) AS h FROM documents",
}


def _sql(source: str, upto: str, select: str, recursive: bool = False) -> str:
    """A query over the CTEs t, s, sa, nb, lc, lz (up to the one named) of a source."""
    steps = {
        "t": _TEXTS[source],
        "s": "SELECT doc_id, h, unnest(range(CAST(length(h) // 2 AS BIGINT))) AS pos FROM t WHERE length(h) > 0",
        "b": "SELECT doc_id, pos, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT) AS byte, substr(h, 2 * pos + 1) AS suf, h FROM s",
        "sa": "SELECT doc_id, pos, suf, byte, h, row_number() OVER (PARTITION BY doc_id ORDER BY suf) - 1 AS rank FROM b",
        "nb": "SELECT a.doc_id, a.rank, a.pos, any_value(a.suf) AS suf, any_value(a.byte) AS byte, any_value(a.h) AS h, arg_max(o.pos, o.rank) FILTER (WHERE o.rank < a.rank) AS psv, arg_min(o.pos, o.rank) FILTER (WHERE o.rank > a.rank) AS nsv, max(o.rank) FILTER (WHERE o.rank < a.rank) AS psv_rank, min(o.rank) FILTER (WHERE o.rank > a.rank) AS nsv_rank FROM sa a LEFT JOIN sa o ON a.doc_id = o.doc_id AND o.pos < a.pos GROUP BY ALL HAVING true",
        "lc": "SELECT doc_id, pos, byte, psv, nsv, coalesce((SELECT max(k) FROM range(1, CAST(length(suf) // 2 AS BIGINT) + 1) z(k) WHERE substr(suf, 1, 2 * k) = substr(h, 2 * psv + 1, 2 * k)), 0) AS lp, coalesce((SELECT max(k) FROM range(1, CAST(length(suf) // 2 AS BIGINT) + 1) z(k) WHERE substr(suf, 1, 2 * k) = substr(h, 2 * nsv + 1, 2 * k)), 0) AS ln FROM nb",
        "lz": "SELECT doc_id, pos, lp, ln, greatest(lp, ln) AS len, CASE WHEN greatest(lp, ln) = 0 THEN byte WHEN nsv IS NULL OR lp > ln THEN psv ELSE nsv END AS src, pos + greatest(1, lp, ln) AS next FROM lc",
        "z": "SELECT doc_id, CAST(0 AS BIGINT) AS seq, pos, src, len, next FROM lz WHERE pos = 0 UNION ALL SELECT z.doc_id, z.seq + 1, lz.pos, lz.src, lz.len, lz.next FROM z JOIN lz ON lz.doc_id = z.doc_id AND lz.pos = z.next",
    }
    order = list(steps)
    used = order[: order.index(upto) + 1]
    return f"WITH {'RECURSIVE ' if 'z' in used else ''}" + ", ".join(f"{k} AS ({steps[k].replace('GROUP BY ALL HAVING true', 'GROUP BY a.doc_id, a.rank, a.pos')})" for k in used) + " " + select


_ROUND0 = "r0 AS (SELECT doc_id, pos, byte + 1 AS r, coalesce(lead(byte + 1, 1) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS r2 FROM b)"
_ROUND1 = _ROUND0 + ", r1 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY r, r2) AS d FROM r0)"


def _round_sql(source: str, more: str, select: str) -> str:
    return _sql(source, "b", "").rstrip() + ", " + more + " " + select


# -- the queries ------------------------------------------------------------------------------


def scan_symbols(spark, sf_dir):
    return symbols(passages(spark, sf_dir))


def byte_counts(spark, sf_dir):
    """Bytes of all documents by value."""
    return corpus.byte_counts(documents(spark, sf_dir))


def prefix_key_rank(spark, sf_dir):
    return suffix.prefix_ranks(passages(spark, sf_dir))


def _pairs(spark, sf_dir):
    return suffix.ahead(suffix.first_ranks(names(spark, sf_dir)), 1)


def rank_lead_k(spark, sf_dir):
    return _pairs(spark, sf_dir)


def group_ids_scan(spark, sf_dir):
    return suffix.group_ids(_pairs(spark, sf_dir)).select("doc_id", "pos", "flag", "gid")


def doubling_round1(spark, sf_dir):
    return suffix.doubled(_pairs(spark, sf_dir))


def segmented_refine(spark, sf_dir):
    first = suffix.prefix_ranks(names(spark, sf_dir), 1).select("doc_id", "pos", (F.col("rank0") + 1).alias("r"))
    return suffix.refined(suffix.ahead(first, 1))


def unsorted_suffixes(spark, sf_dir):
    open_ = suffix.tied(suffix.doubled(_pairs(spark, sf_dir)))
    return open_.groupBy("doc_id").agg(F.count("*").alias("n_open"))


def tie_groups(spark, sf_dir):
    open_ = suffix.tied(suffix.doubled(_pairs(spark, sf_dir)))
    return open_.groupBy("doc_id").agg(F.countDistinct("r").alias("n_groups"))


def rank_changes(spark, sf_dir):
    """Per text the suffixes whose rank (of the group's least member) a round changes."""
    first = suffix.prefix_ranks(names(spark, sf_dir), 1).select("doc_id", "pos", (F.col("rank0") + 1).alias("r"))
    both = suffix.ahead(first, 1).withColumn("new", suffix.refined_rank())  # old and new side by side: a join by position could broadcast all positions
    return both.where("r <> new").groupBy("doc_id").agg(F.count("*").alias("n_changed"))


def doubling_rounds(spark, sf_dir):
    return suffix.doubling_rounds(names(spark, sf_dir))


def suffix_array_naive(spark, sf_dir):
    return suffix.naive(passages(spark, sf_dir))


def suffix_array(spark, sf_dir):
    return suffix.doubling(passages(spark, sf_dir))


def suffix_array_fast(spark, sf_dir):
    return suffix.fast(passages(spark, sf_dir))


def inverse_suffix_array(spark, sf_dir):
    return suffix.suffix_array(passages(spark, sf_dir)).select("doc_id", "pos", "rank")


def sa_isa(spark, sf_dir):
    return local.sa_and_isa(passages(spark, sf_dir))


def lcp_array(spark, sf_dir):
    return local.lcp(names(spark, sf_dir))


def sa_head(spark, sf_dir):
    return suffix.head(suffix.suffix_array(passages(spark, sf_dir)), 5)


def sa_verify(spark, sf_dir):
    """Per document: whether its suffix arrays by two methods are equal."""
    return suffix.verify(documents(spark, sf_dir))


def suffix_array_documents(spark, sf_dir):
    """Per document: suffixes, and a checksum of its suffix array."""
    sa = suffix.suffix_array(documents(spark, sf_dir))
    return sa.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rank", "pos").cast("decimal(38,0)")).alias("checksum"))


def bwt(spark, sf_dir):
    docs = passages(spark, sf_dir)
    return transform.bwt(docs, suffix.suffix_array(docs))


def bwt_isa(spark, sf_dir):
    return local.bwt_isa(passages(spark, sf_dir))


def bwt_large(spark, sf_dir):
    """The transform's bytes as rows, by the operators that spread one text over many tasks."""
    return large.transform(passages(spark, sf_dir), large=0)


def bwt_aux(spark, sf_dir):
    return transform.bwt_aux(suffix.suffix_array(passages(spark, sf_dir)), 16)


def _digest(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.octet_length("bytes").cast("bigint").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


def bwt_roundtrip(spark, sf_dir):
    return _digest(local.unbwt(local.bwt(documents(spark, sf_dir))))


def _neighbours(spark, sf_dir):
    return local.psv_nsv(passages(spark, sf_dir))


def psv(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "rank", "psv")


def nsv(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "rank", "nsv")


def psv_nsv(spark, sf_dir):
    docs = names(spark, sf_dir)
    return neighbours.by_join(suffix.naive(docs)).select("doc_id", "rank", "pos", "psv", "nsv")


def psv_index(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "rank", F.struct(F.col("psv").alias("value"), F.col("psv_rank").alias("index")).alias("e")).select("doc_id", "rank", F.col("e.value").alias("psv"), F.col("e.index").alias("psv_rank"))


def nsv_index(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "rank", F.struct(F.col("nsv").alias("value"), F.col("nsv_rank").alias("index")).alias("e")).select("doc_id", "rank", F.col("e.value").alias("nsv"), F.col("e.index").alias("nsv_rank"))


def psv_text(spark, sf_dir):
    return neighbours.text_order(_neighbours(spark, sf_dir), "psv")


def nsv_text(spark, sf_dir):
    return neighbours.text_order(_neighbours(spark, sf_dir), "nsv")


def psv_large(spark, sf_dir):
    """Both neighbours, by the operators that spread one text over many tasks, in blocks of 64 ranks."""
    return large.neighbours(passages(spark, sf_dir), large=0, block=64).select("doc_id", "rank", "psv", "nsv", "psv_rank", "nsv_rank")


def match_lengths(spark, sf_dir):
    return local.lz_candidates(names(spark, sf_dir)).select("doc_id", "pos", "lp", "ln")


def match_length_pairs(spark, sf_dir):
    """The column function on two given positions of each name: the first, and one in the middle."""
    middle = F.floor(F.octet_length("bytes") / 2).cast("bigint")
    return names(spark, sf_dir).where(F.octet_length("bytes") > 0).select("doc_id", match_length("bytes", F.lit(0).cast("bigint"), middle).alias("n"))


def lz_candidates(spark, sf_dir):
    return local.lz_candidates(names(spark, sf_dir)).select("doc_id", "pos", "lp", "ln", "len", "src", "next")


def lz77_factors(spark, sf_dir):
    return local.lz_factors(names(spark, sf_dir))


def lz77_udtf(spark, sf_dir):
    """The same factors by a table function in SQL."""
    register_lz77(spark)
    names(spark, sf_dir).createOrReplaceTempView("textindex_names")
    return spark.sql("SELECT doc_id, seq, start, src, len FROM lz77(TABLE(textindex_names) PARTITION BY doc_id)")


def lz77_factors_passages(spark, sf_dir):
    return local.lz_factors(passages(spark, sf_dir))


def lz77_encoded_hex(spark, sf_dir):
    return local.lz_encoded(names(spark, sf_dir)).select("doc_id", F.hex("factors").alias("hex"))


def lz77_documents(spark, sf_dir):
    """Per document: bytes, phrases, and a digest of its factor file."""
    return local.lz_encoded(documents(spark, sf_dir)).select("doc_id", "n_bytes", "phrases", F.sha2("factors", 256).alias("sha256"))


def lz77_roundtrip(spark, sf_dir):
    return _digest(local.lz_decoded(local.lz_encoded(documents(spark, sf_dir))))


def lz77_stats(spark, sf_dir):
    """Documents, bytes and phrases by language; every row counts once, whatever its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode("text", "UTF-8").alias("bytes"), "lang")
    return local.lz_encoded(docs, ("lang",)).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("phrases").alias("phrases"))


def document_sizes(spark, sf_dir):
    """Documents and bytes by language, as lz77_stats has them."""
    return lz77_stats(spark, sf_dir).drop("phrases")


def suffix_array_sizes(spark, sf_dir):
    """Suffixes of each document, as suffix_array_documents has them."""
    return suffix_array_documents(spark, sf_dir).drop("checksum")


def pattern_count(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", count_pattern(PATTERN)("bytes").alias("n"))


def longest_repeats(spark, sf_dir):
    return names(spark, sf_dir).select("doc_id", longest_repeat("bytes").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_symbols, byte_counts, prefix_key_rank, rank_lead_k, group_ids_scan, doubling_round1, segmented_refine, unsorted_suffixes, tie_groups, rank_changes,
        doubling_rounds, suffix_array_naive, suffix_array, suffix_array_fast, inverse_suffix_array, sa_isa, lcp_array, sa_head, sa_verify, suffix_array_documents, suffix_array_sizes,
        bwt, bwt_isa, bwt_aux, bwt_large, bwt_roundtrip, psv, nsv, psv_nsv, psv_index, nsv_index, psv_text, nsv_text, psv_large, match_lengths, match_length_pairs, lz_candidates,
        lz77_factors, lz77_udtf, lz77_factors_passages, document_sizes, lz77_encoded_hex, lz77_documents, lz77_roundtrip, lz77_stats, pattern_count, longest_repeats,
    )
}

_SA = _sql("benchmark", "sa", "SELECT doc_id, rank, pos FROM sa")
_BYTES_BACK = "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL"
_LITTLE = " || ".join(f"lpad(hex((CAST({{0}} AS BIGINT) >> {8 * i}) & 255), 2, '0')" for i in range(8))

ORACLES = {
    "scan_symbols": _sql("benchmark", "b", "SELECT doc_id, pos, byte FROM b"),
    "byte_counts": "WITH t AS (SELECT hex(encode(text)) AS h FROM documents), p AS (SELECT unnest(regexp_extract_all(h, '..')) AS x FROM t) SELECT CAST('0x' || x AS BIGINT) AS byte, count(*) AS n FROM p GROUP BY x",
    "prefix_key_rank": _sql("benchmark", "b", "SELECT doc_id, pos, rank() OVER (PARTITION BY doc_id ORDER BY substr(suf, 1, 16)) - 1 AS rank0 FROM b"),
    "rank_lead_k": _round_sql("part", _ROUND0, "SELECT doc_id, pos, r, r2 FROM r0"),
    "group_ids_scan": _round_sql(
        "part", _ROUND0 + ", f AS (SELECT doc_id, pos, r, r2, CASE WHEN (lag(r) OVER w IS NOT DISTINCT FROM r) AND (lag(r2) OVER w IS NOT DISTINCT FROM r2) THEN 0 ELSE 1 END AS flag FROM r0 WINDOW w AS (PARTITION BY doc_id ORDER BY r, r2, pos))",
        "SELECT doc_id, pos, CAST(flag AS BIGINT) AS flag, CAST(sum(flag) OVER (PARTITION BY doc_id ORDER BY r, r2, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gid FROM f",
    ),
    "doubling_round1": _round_sql("part", _ROUND1, "SELECT doc_id, pos, d AS r FROM r1"),
    "segmented_refine": _sql("part", "b", "SELECT doc_id, pos, rank() OVER (PARTITION BY doc_id ORDER BY substr(suf, 1, 4)) AS r FROM b"),
    "unsorted_suffixes": _round_sql("part", _ROUND1, ", g AS (SELECT doc_id, d, count(*) AS n FROM r1 GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_open FROM g WHERE n > 1 GROUP BY doc_id"),
    "tie_groups": _round_sql("part", _ROUND1, ", g AS (SELECT doc_id, d, count(*) AS n FROM r1 GROUP BY ALL) SELECT doc_id, count(*) AS n_groups FROM g WHERE n > 1 GROUP BY doc_id"),
    "rank_changes": _sql("part", "b", ", r AS (SELECT doc_id, rank() OVER (PARTITION BY doc_id ORDER BY substr(suf, 1, 2)) AS a, rank() OVER (PARTITION BY doc_id ORDER BY substr(suf, 1, 4)) AS z FROM b) SELECT doc_id, count(*) AS n_changed FROM r WHERE a <> z GROUP BY doc_id"),
    "doubling_rounds": _sql("part", "b", ", d AS (SELECT doc_id, j, count(DISTINCT substr(suf, 1, CAST(2 * 2 ** j AS BIGINT))) AS d, count(*) AS n FROM b, range(12) x(j) GROUP BY doc_id, j) SELECT doc_id, CAST(min(j) AS BIGINT) AS rounds FROM d WHERE d = n GROUP BY doc_id"),
    "suffix_array_naive": _SA,
    "suffix_array": _SA,
    "suffix_array_fast": _SA,
    "inverse_suffix_array": _sql("benchmark", "sa", "SELECT doc_id, pos, rank FROM sa"),
    "sa_isa": _sql("benchmark", "sa", "SELECT a.doc_id, a.rank AS i, a.pos AS sa, b.rank AS isa FROM sa a JOIN sa b ON a.doc_id = b.doc_id AND a.rank = b.pos"),
    "sa_head": _sql("benchmark", "sa", "SELECT doc_id, rank, pos FROM sa WHERE rank < 5"),
    "sa_verify": "SELECT CAST(doc_id AS BIGINT) AS doc_id, true AS match FROM documents WHERE octet_length(encode(text)) > 0",
    "bwt": _sql("benchmark", "sa", "SELECT doc_id, right(any_value(h), 2) || coalesce(string_agg(substr(h, 2 * pos - 1, 2), '' ORDER BY rank) FILTER (WHERE pos > 0), '') AS l_hex, max(CASE WHEN pos = 0 THEN rank + 1 END) AS primary_index FROM sa GROUP BY doc_id"),
    "bwt_isa": _sql("benchmark", "sa", ", l AS (SELECT doc_id, right(any_value(h), 2) || coalesce(string_agg(substr(h, 2 * pos - 1, 2), '' ORDER BY rank) FILTER (WHERE pos > 0), '') AS l_hex FROM sa GROUP BY doc_id) SELECT sa.doc_id, pos, rank, substr(l_hex, 2 * rank + 1, 2) AS l_byte FROM sa JOIN l ON sa.doc_id = l.doc_id"),
    "lcp_array": _sql("part", "sa", ", l AS (SELECT doc_id, rank, suf, lag(suf) OVER (PARTITION BY doc_id ORDER BY rank) AS pre FROM sa) SELECT doc_id, rank, coalesce((SELECT max(k) FROM range(1, CAST(length(suf) // 2 AS BIGINT) + 1) z(k) WHERE length(pre) >= 2 * k AND substr(suf, 1, 2 * k) = substr(pre, 1, 2 * k)), 0) AS lcp FROM l"),
    "suffix_array_sizes": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE octet_length(encode(text)) > 0",
    "document_sizes": "SELECT lang, count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL GROUP BY lang",
    "bwt_large": _sql("benchmark", "sa", ", f AS (SELECT doc_id, rank AS p FROM sa WHERE pos = 0) SELECT sa.doc_id, CASE WHEN pos = 0 THEN 0 WHEN rank < p THEN rank + 1 ELSE rank END AS place, CASE WHEN pos = 0 THEN CAST('0x' || right(h, 2) AS BIGINT) ELSE CAST('0x' || substr(h, 2 * pos - 1, 2) AS BIGINT) END AS byte FROM sa JOIN f ON sa.doc_id = f.doc_id"),
    "psv_large": _sql("benchmark", "nb", "SELECT doc_id, rank, psv, nsv, psv_rank, nsv_rank FROM nb"),
    "lz77_udtf": _sql("part", "z", "SELECT doc_id, seq, pos AS start, src, len FROM z"),
    "match_length_pairs": _sql("part", "b", ", m AS (SELECT doc_id, h, substr(h, 2 * (length(h) // 4) + 1) AS suf FROM t WHERE length(h) > 0) SELECT doc_id, coalesce((SELECT max(k) FROM range(1, CAST(length(suf) // 2 AS BIGINT) + 1) z(k) WHERE substr(suf, 1, 2 * k) = substr(h, 1, 2 * k)), 0) AS n FROM m"),
    "bwt_aux": _sql("benchmark", "sa", "SELECT doc_id, pos // 16 AS k, rank + 1 AS i FROM sa WHERE pos % 16 = 0"),
    "bwt_roundtrip": _BYTES_BACK,
    "psv": _sql("benchmark", "nb", "SELECT doc_id, rank, psv FROM nb"),
    "nsv": _sql("benchmark", "nb", "SELECT doc_id, rank, nsv FROM nb"),
    "psv_nsv": _sql("part", "nb", "SELECT doc_id, rank, pos, psv, nsv FROM nb"),
    "psv_index": _sql("benchmark", "nb", "SELECT doc_id, rank, psv, psv_rank FROM nb"),
    "nsv_index": _sql("benchmark", "nb", "SELECT doc_id, rank, nsv, nsv_rank FROM nb"),
    "psv_text": _sql("benchmark", "nb", "SELECT doc_id, pos, psv FROM nb"),
    "nsv_text": _sql("benchmark", "nb", "SELECT doc_id, pos, nsv FROM nb"),
    "match_lengths": _sql("part", "lc", "SELECT doc_id, pos, lp, ln FROM lc"),
    "lz_candidates": _sql("part", "lz", "SELECT doc_id, pos, lp, ln, len, src, next FROM lz"),
    "lz77_factors": _sql("part", "z", "SELECT doc_id, seq, pos AS start, src, len FROM z"),
    "lz77_factors_passages": _sql("benchmark", "z", "SELECT doc_id, seq, pos AS start, src, len FROM z"),
    "lz77_encoded_hex": _sql("part", "z", f"SELECT doc_id, string_agg({_LITTLE.format('src')} || {_LITTLE.format('len')}, '' ORDER BY seq) AS hex FROM z GROUP BY doc_id"),
    "lz77_roundtrip": _BYTES_BACK,
    "pattern_count": "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(text)) - octet_length(encode(replace(text, 'th', 't'))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL",
    "longest_repeats": _sql("part", "lc", "SELECT doc_id, max(greatest(lp, ln)) AS n FROM lc GROUP BY doc_id"),
}
