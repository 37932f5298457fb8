"""Operators that index whole texts inside a task: batches of texts go through numpy, nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.store import spread
from . import kernels as K

#: Bytes of texts that are indexed at once.
BATCH_BYTES = 1 << 20
#: The same where two suffix arrays are made and compared: the recursion's arrays stay in the processor's cache.
COMPARE_BYTES = 1 << 18


def _batches(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, K.Batch, list[list]]]:
    ids, texts, carried, size = [], [], [], 0
    for batch in rows:
        for doc_id, raw, *more in zip(batch.column(0).to_pylist(), batch.column(1), *(x.to_pylist() for x in batch.columns[2:]), strict=True):
            text = raw.as_py()
            ids.append(doc_id)
            texts.append(text or b"")
            carried.append(more)
            size += len(texts[-1])
            if size >= most:
                yield ids, K.Batch(texts), carried
                ids, texts, carried, size = [], [], [], 0
    if ids:
        yield ids, K.Batch(texts), carried


def over_texts(corpus: DataFrame, make: Callable[[list, K.Batch], dict[str, object]], schema: str, carry: tuple[str, ...] = (), most: int = BATCH_BYTES) -> DataFrame:
    """Apply make(ids, batch) to batches of whole texts (doc_id, bytes); it returns bigint, binary or string columns.

    With a row for each text, further columns of the corpus can be carried along.
    """
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]
    more = [(c, corpus.schema[c].dataType) for c in carry]
    arrow = [to_arrow_type(t) for _, t in more]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, b, carried in _batches(rows, most):
            made = make(ids, b)
            columns = []
            for name, kind in fields:
                values, absent = made[name], made.get(f"{name}?")
                columns.append(pa.array(values, kind, mask=absent))
            columns += [pa.array([x[i] for x in carried], t) for i, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[f[0] for f in fields] + list(carry))

    return spread(corpus.select("doc_id", "bytes", *carry)).mapInArrow(run, schema + "".join(f", `{c}` {t.simpleString()}" for c, t in more))


def _of(ids: list, b: K.Batch) -> np.ndarray:
    return np.repeat(np.array(ids, np.int64), b.sizes)


def sa_isa(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, pos): the suffix array, and by pos its inverse."""

    def make(ids, b):
        sa, _ = K.suffix_array(b)
        return {"doc_id": _of(ids, b), "rank": np.arange(b.n) - b.start, "pos": sa - b.start}

    return over_texts(corpus, make, "doc_id bigint, rank bigint, pos bigint")


def sa_and_isa(corpus: DataFrame) -> DataFrame:
    """(doc_id, i, sa, isa): the suffix array and its inverse side by side."""

    def make(ids, b):
        sa, isa = K.suffix_array(b)
        return {"doc_id": _of(ids, b), "i": np.arange(b.n) - b.start, "sa": sa - b.start, "isa": isa - b.start}

    return over_texts(corpus, make, "doc_id bigint, i bigint, sa bigint, isa bigint")


def sa_match(corpus: DataFrame) -> DataFrame:
    """(doc_id, match) for each text that isn't empty: whether its suffix arrays by prefix doubling and by the skew algorithm are equal."""

    def make(ids, b):
        ok = K.same(b, K.suffix_array(b)[0], K.skew(b))
        keep = np.flatnonzero(b.sizes)
        return {"doc_id": np.array(ids, object)[keep], "match": ok[keep]}

    return over_texts(corpus, make, "doc_id bigint, match boolean", most=COMPARE_BYTES)


def lcp(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, lcp): the bytes that the suffix of a rank has in common with the one before; 0 for the first."""

    def make(ids, b):
        return {"doc_id": _of(ids, b), "rank": np.arange(b.n) - b.start, "lcp": K.adjacent(b, K.suffix_array(b)[0])}

    return over_texts(corpus, make, "doc_id bigint, rank bigint, lcp bigint")


def psv_nsv(corpus: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, psv, nsv, psv_rank, nsv_rank) in suffix order; null where there is none."""

    def make(ids, b):
        sa, _ = K.suffix_array(b)
        before, after = K.smaller(b, sa)
        return {
            "doc_id": _of(ids, b), "rank": np.arange(b.n) - b.start, "pos": sa - b.start,
            "psv": sa[before] - b.start, "psv?": before < 0, "nsv": sa[after] - b.start, "nsv?": after < 0,
            "psv_rank": before - b.start, "psv_rank?": before < 0, "nsv_rank": after - b.start, "nsv_rank?": after < 0,
        }

    return over_texts(corpus, make, "doc_id bigint, rank bigint, pos bigint, psv bigint, nsv bigint, psv_rank bigint, nsv_rank bigint")


def bwt(corpus: DataFrame) -> DataFrame:
    """(doc_id, l, primary_index) for each text that isn't empty."""

    def make(ids, b):
        l, primary = K.bwt(b, *K.suffix_array(b))
        keep = [k for k in range(len(ids)) if b.sizes[k]]
        return {"doc_id": [ids[k] for k in keep], "l": [l[k] for k in keep], "primary_index": primary[keep]}

    return over_texts(corpus, make, "doc_id bigint, l binary, primary_index bigint")


def bwt_isa(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, rank, l_byte): the inverse suffix array by position, with the transform's byte (two hex digits) at that rank."""
    hexed = [f"{i:02X}" for i in range(256)]

    def make(ids, b):
        sa, isa = K.suffix_array(b)
        column = np.frombuffer(b"".join(K.bwt(b, sa, isa)[0]), np.uint8)
        return {"doc_id": _of(ids, b), "pos": sa - b.start, "rank": np.arange(b.n) - b.start, "l_byte": [hexed[x] for x in column.tolist()]}

    return over_texts(corpus, make, "doc_id bigint, pos bigint, rank bigint, l_byte string")


def bwt_rows(corpus: DataFrame) -> DataFrame:
    """(doc_id, place, byte): the transform's bytes as rows."""

    def make(ids, b):
        column = np.frombuffer(b"".join(K.bwt(b, *K.suffix_array(b))[0]), np.uint8)
        return {"doc_id": _of(ids, b), "place": np.arange(b.n) - b.start, "byte": column.astype(np.int64)}

    return over_texts(corpus, make, "doc_id bigint, place bigint, byte bigint")


def unbwt(transforms: DataFrame) -> DataFrame:
    """(doc_id, bytes) from (doc_id, l, primary_index)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [K.unbwt(l.as_py(), p) for l, p in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return transforms.select("doc_id", "l", "primary_index").mapInArrow(run, "doc_id bigint, bytes binary")


def lz_candidates(corpus: DataFrame) -> DataFrame:
    """(doc_id, pos, psv, nsv, lp, ln, len, src, next) for every position."""

    def make(ids, b):
        psv, nsv, lp, ln = K.candidates(b)
        source, length = K.choose(b, psv, nsv, lp, ln)
        pos = np.arange(b.n) - b.start
        return {
            "doc_id": _of(ids, b), "pos": pos, "psv": psv - b.start, "psv?": psv < 0, "nsv": nsv - b.start, "nsv?": nsv < 0,
            "lp": lp, "ln": ln, "len": length, "src": source, "next": pos + np.maximum(1, length),
        }

    return over_texts(corpus, make, "doc_id bigint, pos bigint, psv bigint, nsv bigint, lp bigint, ln bigint, len bigint, src bigint, next bigint")


def lz_factors(corpus: DataFrame) -> DataFrame:
    """(doc_id, seq, start, src, len): the greedy LZ77 parse; len 0: src is the literal byte."""

    def make(ids, b):
        text, start, source, length = K.factors(b)
        first = np.searchsorted(text, np.arange(len(ids)))
        return {"doc_id": np.array(ids, np.int64)[text], "seq": np.arange(len(text)) - first[text], "start": start, "src": source, "len": length}

    return over_texts(corpus, make, "doc_id bigint, seq bigint, start bigint, src bigint, len bigint")


def _record(source: np.ndarray, length: np.ndarray) -> bytes:
    return np.stack([source, length], axis=1).astype("<u8").tobytes()


def lz_encoded(corpus: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, factors, phrases, n_bytes): 16 bytes a factor, little-endian source and length; a row for each text, with the columns to carry."""

    def make(ids, b):
        text, _, source, length = K.factors(b)
        at = np.searchsorted(text, np.arange(len(ids) + 1))
        return {"doc_id": ids, "factors": [_record(source[i:j], length[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], "phrases": np.diff(at), "n_bytes": b.sizes}

    return over_texts(corpus, make, "doc_id bigint, factors binary, phrases bigint, n_bytes bigint", carry)


def lz_decoded(encoded: DataFrame) -> DataFrame:
    """(doc_id, bytes) from (doc_id, factors)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = []
            for raw in batch.column(1):
                pairs = np.frombuffer(raw.as_py(), "<u8").reshape(-1, 2)
                texts.append(K.decode(pairs[:, 0].tolist(), pairs[:, 1].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "factors").mapInArrow(run, "doc_id bigint, bytes binary")
