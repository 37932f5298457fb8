"""Byte-pair encoding and decoding.

A piece of text (as the vocabulary's pre-tokenizer cuts it) becomes a doubly linked list of
byte symbols. A heap holds (merge rank, position) of all adjacent pairs that can merge; the
least comes first, entries whose pair has changed since are stale and skipped, and each merge
pushes the two pairs it makes. Decoding concatenates the vocabulary's byte strings.

Pieces repeat: Arrow cuts and numbers the pieces of some texts at once, each worker keeps the ids of
those it has encoded, up to a fixed number of bytes, and numpy gathers them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import gather, map_batches, table

#: Bytes of pieces and their ids after which a worker begins anew (it looks into those before as well), and what an entry takes besides, about.
KEEP, ENTRY = 48 << 20, 180
#: Bytes of text that are encoded at once (one text at least).
BATCH_BYTES = 4_000_000
# The pre-tokenizer's pattern of this public vocabulary family.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: What stands before a special token among the pieces: no piece has a space behind another character.
SPECIAL = "\x1f \x1f"
#: The same in Arrow's notation for texts without other characters than PLAIN, in which GAP has put a mark before
#: the last of several spaces that a word follows (Arrow's patterns can't look ahead).
SPACE, MARK = r"\x09-\x0d\x20", "\x1f"
PLAIN = SPACE + r"\x21-\x7e\x{a1}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}"
CUT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}{MARK}\p{{L}}\p{{N}}]+|[{SPACE}]+"
GAP = f"([{SPACE}]+)([{SPACE}][^{SPACE}])"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str, keep: int | None = None):
        self.keep = KEEP if keep is None else keep
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.strings[t["id"]] = t["content"].encode()
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 20 | vocab[b]] = len(self.made)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PIECE).findall
        self.odd = "|".join([f"[^{PLAIN}]", *(rf"\Q{x}\E" for x in self.special)])
        self.table = pa.array(self.strings, pa.binary())
        self.forget()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        rank, sym = self.rank.get, [self.first[b] for b in data]
        n = len(sym)
        now = [rank(a << 20 | b) for a, b in zip(sym, sym[1:], strict=False)]  # the rank of the pair that begins at each position
        heap = [r << 32 | i for i, r in enumerate(now) if r is not None]
        if not heap:
            return sym
        heapify(heap)
        now.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made = self.made
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if now[i] != r:
                continue  # stale
            j = after[i]
            new = sym[i] = made[r]
            sym[j], now[j] = -1, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = q = rank(new << 20 | sym[k])
                if q is not None:
                    heappush(heap, q << 32 | i)
            else:
                now[i] = None
            if (h := before[i]) >= 0:
                now[h] = q = rank(sym[h] << 20 | new)
                if q is not None:
                    heappush(heap, q << 32 | h)
        return [s for s in sym if s >= 0]

    def forget(self) -> None:
        """Begin without pieces but those kept so far, which become the old ones."""
        self.old = (self.known, self.flat, self.starts, self.lengths) if hasattr(self, "known") else ({}, None, None, None)
        self.known: dict[str, int] = {"": 0}
        self.flat, self.starts, self.lengths, self.held = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def _ids(self, piece: str) -> list[int]:
        known, flat, starts, lengths = self.old
        if (k := known.get(piece)) is not None:
            return flat[(a := starts[k]) : a + lengths[k]].tolist()
        return [self.special[piece[len(SPECIAL) :]]] if piece.startswith(SPECIAL) else self.merge(piece.encode("utf-8", "surrogatepass"))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, whose ids stand at starts[number] in flat."""
        lack = [p for p in pieces if p not in self.known]
        if self.held + sum(map(len, lack)) + ENTRY * len(lack) > self.keep and self.held:
            self.forget()
            lack = [p for p in pieces if p]
        if lack:
            made = [self._ids(p) for p in lack]
            self.known.update(zip(lack, range(len(self.lengths), len(self.lengths) + len(lack)), strict=True))
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, made), np.int64, len(made))])
            self.flat = np.concatenate([self.flat, np.array([i for ids in made for i in ids], "<u4")])
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.held += sum(map(len, lack)) + ENTRY * len(lack)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The pieces of each text, and empty ones between."""
        doubled = pc.match_substring_regex(texts, f"[{SPACE}][{SPACE}]")
        if pc.any(doubled).as_py():
            texts = pc.replace_substring_regex(texts, GAP, rf"\1{MARK}\2")
        return pc.split_pattern(pc.replace_substring_regex(texts, CUT, rf"\0{MARK}"), MARK)

    def _odd(self, text: str) -> list[str]:
        """The pieces of any text; special tokens with SPECIAL in front."""
        parts = self.split_special.split(text) if self.split_special else [text]
        return [y for x in parts if x for y in ([SPECIAL + x] if x in self.special else self.find(x))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and how many each text has; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        cut = self._cut(texts.filter(pa.array(~odd)))
        others = [self._odd(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        found = pa.concat_arrays([cut.flatten(), pa.array([p for x in others for p in x], pa.string())]).dictionary_encode()
        number = self._numbers(found.dictionary.to_pylist())[found.indices.to_numpy()]
        lengths = self.lengths[number]
        ids = gather(self.flat, self.starts[number], lengths)
        at = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        pieces = np.concatenate([pc.list_value_length(cut).to_numpy(zero_copy_only=False), np.array([len(x) for x in others], np.int64)])
        before = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *pieces])]
        starts, n = np.empty(len(odd), np.int64), np.empty(len(odd), np.int64)
        starts[at], n[at] = before[:-1], np.diff(before)
        return gather(ids, starts, n) if odd.any() else ids, n

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[bytes]:
        """The text of each run of ids, as the UTF-8 of what the library's decoder returns."""
        data = self.table.take(pa.array(ids.astype(np.int64)))
        ends = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1)[np.cumsum([0, *lengths])]
        raw = memoryview(data.buffers()[2] or b"")
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield bytes(raw[a:b]).decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str, keep: int | None = None) -> Codec:
    return Codec(path, keep)


def encode_decode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row of docs, in whatever order and partition it stands.

    A null text counts as empty: no ids, empty decoded text. Null and repeated ids pass through,
    rows stay as many as they are, other columns of docs aren't read, whatever their names. Texts are encoded whole,
    however long; an empty table gives no rows.
    """
    path = path or default_path()

    def each(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids, n = c.encode(batch.column(1))
        ends = np.cumsum([0, *4 * n])
        raw = ids.tobytes()
        return {"doc_id": batch.column(0), "ids": [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], "decoded": [x.decode() for x in c.decode(ids, n)]}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), each, f"doc_id {kind}, ids binary, decoded string", BATCH_BYTES)


def digests(docs: DataFrame, path: str | None = None, keep_ids: bool = False, keep: int = KEEP, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """encode_decode() reduced where it is made: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves.

    keep and batch_bytes bound what a worker keeps and works on at once; less of them costs time, the result is the same.
    """
    path = path or default_path()

    def each(batch: pa.RecordBatch) -> dict:
        c = codec(path, keep)
        ids, n = c.encode(batch.column(1))
        ends = np.cumsum([0, *4 * n]).tolist()
        raw = memoryview(ids.tobytes())
        own = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        out = {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": [hashlib.sha256(x).hexdigest() for x in own], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in c.decode(ids, n)]}
        return out | ({"ids": [bytes(x) for x in own]} if keep_ids else {})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), each, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids, batch_bytes)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
