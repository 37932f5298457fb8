"""What several operators of this subpackage share: shared tables, words, Arrow maps."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir, shared_table  # noqa: F401
from ..sources.sinks import open_store  # noqa: F401

#: A word: a run without ASCII white space. `bytes.split()` splits at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"

ROWS_AT_ONCE = 1000
#: Ranges of a key at most; beyond that the ranges get larger, and what works on them streams.
MOST_RANGES = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Its texts are long, so the session's Arrow batches get ROWS_AT_ONCE rows at most."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= ROWS_AT_ONCE:
        spark.conf.set(setting, ROWS_AT_ONCE)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case (`bytes.lower` changes nothing else)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def slices(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows, with `most` bytes in that column and ROWS_AT_ONCE rows at a time at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, min(b - a, ROWS_AT_ONCE))
            a = min(b, a + ROWS_AT_ONCE)


#: What empties the caches of a worker that are worth little to its next task; modules that have one add it.
CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Empty CACHES and give back what a worker has freed: Arrow's pool and the C library keep it otherwise, and a worker that waits for its next task still counts."""
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with release() when a task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return released


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict | None], schema: str, most: int | None = None) -> DataFrame:
    """mapInArrow with a function from at most ROWS_AT_ONCE rows, and `most` bytes in the second column, to a dict of columns in the order of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most) if most else (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            if (made := each(part)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(releasing(run), schema)


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: What a null key counts as among ranges: less than any other.
NO_KEY = -(2**63)


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """parts - 1 cut points at most that split the sorted keys into even ranges; a key with many rows is several of them.

    The percentile sketch has a fixed size; the driver gets one number for each part. Null keys are in front.
    Any bounds give right results, these even ones.
    """
    parts = min(parts, MOST_RANGES)
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.coalesce(F.col(key), F.lit(NO_KEY)), F.lit(at), F.lit(max(1000, 20 * parts))).alias("q")).first()["q"]
    return sorted(got or [])


def range_of(key: str, bounds: list[int], tie: str):
    """The number of the range that a row is in, by its key; rows of a key that is several bounds go by the tie, a number, to the ranges between."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series, ties: pd.Series) -> pd.Series:
        x = ids.astype("int64").to_numpy()
        low, high = np.searchsorted(cuts, x, side="left"), np.searchsorted(cuts, x, side="right")
        # one bound: all behind it; several: evenly over the ranges before, between and behind them
        part = (ties.to_numpy().astype(np.int64).view(np.uint64) % np.maximum(1, high - low + 1).astype(np.uint64)).astype(np.int64)
        return pd.Series(np.where(high - low > 1, low + part, high).astype("int32"))

    return find(F.coalesce(F.col(key), F.lit(NO_KEY)), F.col(tie))


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row; which of them are null counts too."""
    plain = [F.col(f"`{f.name}`").cast("string") if "map<" in (kind := f.dataType.simpleString()) or "variant" in kind else F.col(f"`{f.name}`") for f in df.schema]
    return F.xxhash64(*plain, *[x.isNull() for x in plain])


def hash_sample(df: DataFrame, n: int) -> DataFrame:
    """About n rows of df: all, or those of a low hash, rows that are equal in every column once.

    The same rows for the same table. Only a count goes to the driver; nothing is sorted.
    """
    count = df.count()
    if count > n:
        df = df.where(row_hash(df) < F.lit(int(-(2**63) + 2**64 * n // count)))
    return df.dropDuplicates()
