"""Column functions: common lengths of suffixes, pattern counts, longest repeats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators import kernels as K
from ..operators.local import BATCH_BYTES


@F.pandas_udf(LongType())
def match_length(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Bytes that the suffixes at a and b have in common, up to the text's end; null where a position is null."""
    out = []
    for t, i, j in zip(texts, a, b, strict=True):
        if pd.isna(i) or pd.isna(j):
            out.append(None)
            continue
        lo, hi = sorted((int(i), int(j)))
        out.append(len(t) - hi if lo == hi else K.extend(t, hi, lo, 0, len(t)))
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(LongType())
def longest_repeat(texts: pd.Series) -> pd.Series:
    """Bytes of the longest substring that occurs twice: the largest factor candidate of any position."""
    b = K.Batch([t or b"" for t in texts])
    if not b.n:
        return pd.Series([0] * len(texts), dtype="int64")
    _, _, lp, ln = K.candidates(b)
    best = np.zeros(len(b.texts), np.int64)
    np.maximum.at(best, np.repeat(np.arange(len(b.texts)), b.sizes), np.maximum(lp, ln))
    return pd.Series(best)


def count_pattern(pattern: bytes):
    """A function (bytes) -> how often the pattern occurs, overlaps included, by two binary searches of the suffix array.

    The suffix arrays of the column's texts are built together, BATCH_BYTES at a time.
    """
    m = len(pattern)

    def bound(text: bytes, sa: np.ndarray, after: bool) -> int:
        lo, hi = 0, len(sa)
        while lo < hi:
            mid = (lo + hi) // 2
            piece = text[sa[mid] : sa[mid] + m]
            if piece < pattern or (after and piece == pattern):
                lo = mid + 1
            else:
                hi = mid
        return lo

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        out, held, size = [], [], 0

        def flush() -> None:
            b = K.Batch(held)
            sa = K.suffix_array(b)[0] - b.start
            for t, i, j in zip(held, b.starts.tolist(), b.ends.tolist(), strict=True):
                out.append(bound(t, sa[i:j], True) - bound(t, sa[i:j], False) if m else 0)
            held.clear()

        for t in texts:
            held.append(t or b"")
            size += len(held[-1])
            if size >= BATCH_BYTES:
                flush()
                size = 0
        flush()
        return pd.Series(out, dtype="int64")

    return count


def register_lz77(spark: SparkSession) -> None:
    """Make `lz77` a table function of SQL: SELECT * FROM lz77(TABLE(t) PARTITION BY doc_id), t having doc_id and bytes."""

    class Lz77:
        def eval(self, row: Row):
            text, start, source, length = K.factors(K.Batch([bytes(row["bytes"] or b"")]))
            for seq, (a, s, n) in enumerate(zip(start.tolist(), source.tolist(), length.tolist(), strict=True)):
                yield row["doc_id"], seq, a, s, n

    spark.udtf.register("lz77", F.udtf(Lz77, returnType="doc_id bigint, seq bigint, start bigint, src bigint, len bigint"))
