"""Token ids in files of patched frame-of-reference blocks.

A file holds whole documents in ascending id order: a header, the table of documents (id, null
flag, number of ids), the start of each block, the blocks. A block holds BLOCK ids: its minimum
is subtracted, the differences are packed at a width that a percentile of their bit lengths
gives (of the PERCENTILES the one that makes the block smallest), and what needs more bits
stands whole in the block's exception list as (position, value).
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gather, open_store, range_bounds, range_of, shared_dir, shared_table, slices, table, words

BLOCK = 512
PERCENTILES = (50, 75, 85, 90, 95, 98, 100)
FILE_IDS = 4_000_000
MAGIC = b"PFORIDS1"
END = 1
#: Pieces that a worker keeps.
KEEP = 400_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 4_000_000
BYTES_A_RANGE = 24_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- the format ---------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The blocks of a stream of ids, and each block's start in bytes (with the end at last)."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return [], np.zeros(1, "<u8")
    full = np.empty(count * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    rows = full.reshape(count, BLOCK)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    bits = (np.maximum(rows.astype(np.float32).view(np.int32) >> 23, 126) - 126).astype(np.uint8)  # the float's exponent; never too few
    ranked = np.sort(bits, axis=1)
    widths = np.stack([ranked[:, min(BLOCK - 1, BLOCK * p // 100)] for p in PERCENTILES], axis=1)
    over = np.stack([(ranked > w[:, None]).sum(axis=1) for w in widths.T], axis=1)
    best = np.argmin(widths.astype(np.int64) * (BLOCK // 8) + 6 * over, axis=1)
    width, n_over = widths[np.arange(count), best], over[np.arange(count), best]
    blocks: list[bytes] = [b""] * count
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for part in np.array_split(at, -(-len(at) // 2048)):
            low = rows[part]
            packed = _whole(low, int(w)) if w in (8, 16, 32) else np.packbits((low[:, :, None] >> np.arange(w, dtype=np.uint32) & 1).astype(np.uint8).reshape(len(part), -1), axis=1, bitorder="little") if w else np.empty((len(part), 0), np.uint8)
            for k, i in enumerate(part.tolist()):
                head = int(least[i]).to_bytes(4, "little") + bytes([int(w)]) + int(n_over[i]).to_bytes(2, "little")
                if n_over[i]:
                    where = np.flatnonzero(bits[i] > w)
                    blocks[i] = head + packed[k].tobytes() + where.astype("<u2").tobytes() + rows[i, where].astype("<u4").tobytes()
                else:
                    blocks[i] = head + packed[k].tobytes()
    return blocks, np.cumsum([0, *map(len, blocks)]).astype("<u8")


def _whole(low: np.ndarray, w: int) -> np.ndarray:
    """Widths of whole integers: the same bytes as packing bit by bit."""
    return low.astype(f"<u{w // 8}").view(np.uint8).reshape(len(low), -1)


def unpack(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ids of the blocks that begin at starts in data (bytes), n in all."""
    count = len(starts) - 1
    out = np.empty((count, BLOCK), np.uint32)
    at = starts[:-1].astype(np.int64)
    least = data[at[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if count else np.empty(0, "<u4")
    width = data[at + 4]
    n_over = data[at + 5].astype(np.int64) + 256 * data[at + 6].astype(np.int64)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        for part in np.array_split(which, -(-len(which) // 1024)):
            if not w:
                out[part] = 0
                continue
            raw = data[at[part][:, None] + np.arange(7, 7 + w * BLOCK // 8)]
            if w in (8, 16, 32):
                out[part] = raw.view(f"<u{w // 8}")
                continue
            wide = np.zeros((len(part), BLOCK, 32), np.uint8)
            wide[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(part), BLOCK, w)
            out[part] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i in np.flatnonzero(n_over).tolist():
        a = int(at[i]) + 7 + int(width[i]) * BLOCK // 8
        m = int(n_over[i])
        out[i, data[a : a + 2 * m].copy().view("<u2")] = data[a + 2 * m : a + 6 * m].copy().view("<u4")
    return (out + least[:, None]).reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks, starts = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(blocks), BLOCK], "<u8").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes() + np.array(lengths, "<u8").tobytes()
    return b"".join([MAGIC, head, docs, starts.tobytes(), *blocks])


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, number of ids of each, all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, n, n_blocks, block = np.frombuffer(raw, "<u8", 4, 8).tolist()
    if block != BLOCK:
        raise ValueError(f"blocks of {block} ids")
    a = 40
    doc_ids = np.frombuffer(raw, "<i8", n_docs, a).tolist()
    null = np.frombuffer(raw, "u1", n_docs, a := a + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, a := a + n_docs).astype(np.int64)
    starts = np.frombuffer(raw, "<u8", n_blocks + 1, a := a + 8 * n_docs)
    data = np.frombuffer(raw, np.uint8, offset=a + 8 * (n_blocks + 1))
    return [None if z else x for x, z in zip(doc_ids, null.tolist(), strict=True)], lengths, unpack(data, starts, n)


def read_slice(f: pa.NativeFile, start: int, n: int) -> np.ndarray:
    """n ids from the start-th of a file on; besides the header only the blocks that hold them are read, found by the block starts."""
    magic = f.read_at(40, 0)
    if magic[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_docs, total, n_blocks, block = np.frombuffer(magic, "<u8", 4, 8).tolist()
    n = max(0, min(n, total - start))
    if not n:
        return np.empty(0, np.uint32)
    first, last = start // block, -(-(start + n) // block)
    table_at = 40 + 17 * n_docs
    starts = np.frombuffer(f.read_at(8 * (last - first + 1), table_at + 8 * first), "<u8").astype(np.int64)
    data = f.read_at(int(starts[-1] - starts[0]), table_at + 8 * (n_blocks + 1) + int(starts[0]))
    ids = unpack(np.frombuffer(data, np.uint8), starts - starts[0], (last - first) * block)
    return ids[start - first * block :][:n]


# -- the tokenizer ------------------------------------------------------------------------


class WordEncoder:
    """The library's ids of whole texts, from its ids of their pieces.

    The vocabulary's pre-tokenizer drops white space and no token reaches across a piece that it
    cuts. Texts of Latin letters and ASCII signs (NFC leaves these alone, lower case is one letter
    for one) are lower-cased, cut by the pre-tokenizer's pattern and numbered by Arrow, so that
    the library's model gets each distinct piece once in a while, many at a time; the last token
    of a piece carries the end of word, and numpy gathers the ids. Of other texts the words are
    told apart: those in Latin letters go the same way, the rest to the whole tokenizer.
    """

    # The pre-tokenizer's pattern of this public vocabulary, but for its runs of letters, which stay between.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\x09-\x0d\x20\p{L}\p{N}]+"
    LATIN = r"\x21-\x7e\u00a1-\u012f\u0131-\u024f"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.lib, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.lib, self.bare):
            t.no_truncation()
            t.no_padding()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.lib.get_vocab()
        self.last = np.zeros(1 + max(vocab.values()), bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.latin = re.compile(f"[{self.LATIN}]+").fullmatch
        # the same class in Arrow's notation, and the mark that special tokens begin with
        self.odd = "[^" + re.sub(r"\\u(....)", r"\\x{\1}", self.LATIN) + r"\x09-\x0d\x20]|<\|"
        self.forget()

    def forget(self) -> None:
        """Begin without pieces."""
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.starts, self.lengths = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ids(self, texts: list[str], tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, lack: list[str]) -> None:
        """Number these pieces and append their ids; all pieces that the worker keeps stand in one array."""
        flat, lengths = [self.flat], [self.lengths]
        for i in range(0, len(lack), 2000):
            some = lack[i : i + 2000]
            ids = self._ids([" ".join(some)], self.bare)[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a piece is not one word of the model")
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        self.pieces.update(zip(lack, range(len(self.lengths), len(self.lengths) + len(lack)), strict=True))
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in Latin letters, and how many each has."""
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self.PIECE, r" \0 "))
        found = cut.flatten().dictionary_encode()
        names, order = found.dictionary.to_pylist(), found.indices.to_numpy()
        if len(self.pieces) + len(names) > KEEP or len(self.flat) > 8 * KEEP:
            self.forget()
        if lack := [p for p in names if p not in self.pieces]:
            self._learn(lack)
        number = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))[order]
        lengths = self.lengths[number]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        return gather(self.flat, self.starts[number], lengths), np.diff(before[ends], prepend=0)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any texts, by way of their distinct words."""
        each = [words(t) for t in texts]
        coded = pa.array([w for ws in each for w in ws], pa.binary()).dictionary_encode()
        distinct = b"\n".join(coded.dictionary.to_pylist()).decode("utf-8", "surrogatepass").split("\n") if len(coded) else []
        is_plain = np.fromiter((bool(self.latin(w)) and "<|" not in w for w in distinct), bool, len(distinct))
        plain, other = [w for w, ok in zip(distinct, is_plain, strict=True) if ok], [w for w, ok in zip(distinct, is_plain, strict=True) if not ok]
        flat, lengths = self._cut(pa.array(plain, pa.string()))
        whole = self._ids(other, self.lib) if other else []
        flat = np.concatenate([flat, *whole])
        own, at = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        own[is_plain], own[~is_plain] = lengths, [len(x) for x in whole]
        at[is_plain] = np.cumsum(lengths) - lengths
        at[~is_plain] = int(lengths.sum()) + np.cumsum(own[~is_plain]) - own[~is_plain]
        order = coded.indices.to_numpy() if len(coded) else np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(own[order])])
        return gather(flat, at[order], own[order]), np.diff(before[np.cumsum([0, *map(len, each)])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        flat, lengths = self._cut(texts.filter(pa.array(~odd)))
        if not odd.any():
            return flat, lengths
        more, other = self._words(texts.filter(pa.array(odd)).to_pylist())
        own, at = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        own[~odd], own[odd] = lengths, other
        at[~odd] = np.cumsum(lengths) - lengths
        at[odd] = len(flat) + np.cumsum(other) - other
        return gather(np.concatenate([flat, more]), at, own), own


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind each text's ids."""
    stops = np.cumsum(lengths + 1) - 1
    out = np.empty(len(ids) + len(lengths), "<u4")
    out[stops] = end
    inside = np.ones(len(out), bool)
    inside[stops] = False
    out[inside] = ids
    return out, lengths + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- the operator -------------------------------------------------------------------------


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, parts: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write them to files in the folder, in ascending doc_id order.

    Returns one row a file, read from a shared table: range, seq, file, n_docs, n_ids. A file's
    name is unique to the attempt that wrote it and only the rows of successful attempts
    are in the table, so a lost executor leaves at most a file that nothing refers to.

    A null text is empty (the end id alone), null ids come first, rows that repeat an id stay next to each other (in
    several files where they are many), an empty table writes no files; other columns, clashing names too, aren't read.
    Texts are encoded whole, however long; a file holds whole documents and gets larger with them.
    """
    path = path or default_path()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    if parts is None:
        parts = max(1, docs.agg(F.sum(F.length("text"))).first()[0] or 0) // BYTES_A_RANGE + 1
    bounds = range_bounds(docs, "doc_id", parts)
    ranged = docs.withColumn("tie", F.xxhash64("text")).withColumn("range", range_of("doc_id", bounds, "tie"))
    ranged = ranged.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        fs, at = open_store(folder)
        fs.create_dir(at, recursive=True)
        held: list[np.ndarray] = []
        who: list[int | None] = []
        sizes: list[int] = []
        state = {"range": None, "seq": 0, "n": 0}

        def flush() -> Iterator[pa.RecordBatch]:
            if not who:
                return
            ids = np.concatenate(held)
            name = f"{state['range']:08d}-{state['seq']:06d}-{uuid.uuid4().hex}.pfor"
            with fs.open_output_stream(f"{at}/{name}") as out:
                out.write(file_bytes(who, sizes, ids))
            yield pa.RecordBatch.from_pydict({"range": pa.array([state["range"]], pa.int32()), "seq": pa.array([state["seq"]], pa.int32()), "file": pa.array([name]), "n_docs": pa.array([len(who)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64())})
            for x in (held, who, sizes):
                x.clear()
            state.update(seq=state["seq"] + 1, n=0)

        for batch in slices(batches, BATCH_BYTES):
            ids, lengths = with_end(*enc.encode(batch.column(1)), end)
            stops = np.cumsum(lengths).tolist()
            a = 0
            for doc, stop, n, rng in zip(batch.column(0).to_pylist(), stops, lengths.tolist(), batch.column(2).to_pylist(), strict=True):
                if rng != state["range"] or state["n"] >= FILE_IDS:
                    if (done := stop - n) > a:
                        held.append(ids[a:done])
                        a = done
                    yield from flush()
                    if rng != state["range"]:
                        state.update(range=rng, seq=0)
                who.append(doc)
                sizes.append(n)
                state["n"] += n
            held.append(ids[a:])
        yield from flush()

    files = ranged.select("doc_id", "text", "range").mapInArrow(run, "range int, seq int, file string, n_docs bigint, n_ids bigint")
    return shared_table(files, "token-files", spark)


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ranges = files.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inner = Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    at = files.withColumn("own", F.sum("n_ids").over(inner) - F.col("n_ids")).join(ranges, F.col("range") == F.col("r"))
    at = at.select("file", (F.col("own") + F.col("before")).alias("start"))
    todo = at.repartition(max(1, files.count()), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_store(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{where}/{name}") as f:
                    doc_ids, lengths, ids = read_file(f.read())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return todo.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    return read_files(write_files(table(spark, sf_dir, "documents"), folder), folder)
