"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, all of which are read. A GRU runs over a window
from either side; at every position both states give the probabilities of the languages, and
a document's probabilities are the means over its positions. The network is trained with numpy by
backpropagation through time and Adam, every position labelled with its document's language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, remainder, shared_table, table

WINDOW, HIDDEN = 64, 8
PAD = 256
#: Documents that the network is fitted on, about, and of each language at least: those with a low hash.
SAMPLE, LEAST = 2400, 40
WINDOWS_A_DOCUMENT, WINDOWS_A_LANGUAGE = 6, 3000
STEPS, BATCH, RATE = 500, 128, 0.02
AT_ONCE = 2048
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}").search


def windows(data: bytes) -> np.ndarray:
    """All bytes in rows of WINDOW, the last padded."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, PAD, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Weights of both directions (table of input gates, recurrent matrix) and of the output."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(langs)
        self.langs = langs
        self.w = {}
        for d in "fb":
            self.w[f"e{d}"] = rng.normal(0, 0.3, (PAD + 1, 3 * h)).astype(np.float32)
            self.w[f"u{d}"] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.w[f"o{d}"] = rng.normal(0, h**-0.5, (h, n)).astype(np.float32)
        self.w["c"] = np.zeros(n, np.float32)

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States at every position, shape (time, row, hidden); with keep also what the way back needs."""
        h, rows, time = HIDDEN, *x.shape
        e, u = self.w[f"e{d}"], self.w[f"u{d}"]
        out = np.empty((time, rows, h), np.float32)
        s = np.zeros((rows, h), np.float32)
        path = []
        columns = np.ascontiguousarray(x.T)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            i, r = e.take(columns[t], axis=0), s @ u
            gates = i[:, : 2 * h] + r[:, : 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, q = gates[:, :h], gates[:, h:]
            new = q * r[:, 2 * h :]
            new += i[:, 2 * h :]
            np.tanh(new, out=new)
            if keep:
                path.append((t, s, z, q, r[:, 2 * h :], new))
            s = new + z * (s - new)
            out[t] = s
        return out, path

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language at each position: (time, row, language)."""
        f, b = self.states(x, "f")[0], self.states(x, "b")[0]
        p = f.reshape(-1, HIDDEN) @ self.w["of"] + b.reshape(-1, HIDDEN) @ self.w["ob"] + self.w["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(WINDOW, len(x), len(self.langs))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of all positions that aren't padding, and its gradient."""
        h = HIDDEN
        (f, pf), (b, pb) = self.states(x, "f", True), self.states(x, "b", True)
        logits = f @ self.w["of"] + b @ self.w["ob"] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x.T != PAD).astype(np.float32)
        n = max(1.0, float(real.sum()))
        rows = np.arange(len(x))
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * real).sum() / n)
        p[:, rows, y] -= 1
        p *= real[:, :, None] / n
        g = {"c": p.sum(axis=(0, 1))}
        for d, s, path in (("f", f, pf), ("b", b, pb)):
            e, u = np.zeros_like(self.w[f"e{d}"]), np.zeros_like(self.w[f"u{d}"])
            g[f"o{d}"] = s.reshape(-1, h).T @ p.reshape(-1, p.shape[2])
            ds_out = p @ self.w[f"o{d}"].T
            ds = np.zeros((len(x), h), np.float32)
            for t, before, z, q, rn, new in reversed(path):
                ds = ds + ds_out[t]
                da = ds * (1 - z) * (1 - new * new)
                dz = ds * (before - new) * z * (1 - z)
                dq = da * rn * q * (1 - q)
                di = np.concatenate([dz, dq, da], axis=1)
                dr = np.concatenate([dz, dq, da * q], axis=1)
                u += before.T @ dr
                np.add.at(e, x[:, t], di)
                ds = ds * z + dr @ self.w[f"u{d}"].T
            g[f"e{d}"], g[f"u{d}"] = e, u
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> float:
        """Adam over random batches; returns the last losses' mean."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            loss, g = self.gradients(x[pick], y[pick])
            losses.append(loss)
            rate = RATE * min(1.0, 2 * (1 - (i - 1) / steps) + 0.02)
            for k, w in self.w.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                w -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)
        return float(np.mean(losses[-20:]))

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text; nought for empty ones."""
        sizes = np.array([-(-len(t) // WINDOW) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        rows = np.full((int(sizes.sum()), WINDOW), PAD, np.int16)
        flat, ends = rows.reshape(-1), np.cumsum(sizes)
        for t, a in zip(texts, ((ends - sizes) * WINDOW).tolist(), strict=True):
            flat[a : a + len(t)] = np.frombuffer(t, np.uint8)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for a in range(0, len(rows), AT_ONCE):
            x = rows[a : a + AT_ONCE]
            p = self.probabilities(x)
            p *= (x.T != PAD)[:, :, None]
            np.add.at(out, owner[a : a + AT_ONCE], p.sum(axis=0))
        return out / np.maximum(1, [[len(t)] for t in texts])


def sampled_windows(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Windows of text for each language of docs (text, lang) with no null in them.

    Every language gets the same share of `sample` documents, LEAST at least: those whose hash is low for its number of rows, or
    all. Rows that are equal count once. Of a document, however long, WINDOWS_A_DOCUMENT evenly spaced windows are cut where it
    stands, and only these go to the driver.
    """
    held = shared_table(docs.groupBy("lang").agg(F.count("*").alias("n")), "languages", docs.sparkSession)  # a row for each language
    quota = max(LEAST, sample // max(1, held.count()))
    low = (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), quota / F.col("n"))).alias("low")
    some = docs.join(F.broadcast(held.select(F.col("lang").alias("l"), low)), F.col("lang") == F.col("l")).where(F.xxhash64("text", "lang").cast("double") <= F.col("low")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = windows(text.as_py().encode("utf-8", "surrogatepass"))
                if len(w):
                    langs.append(lang)
                    found.append(w[np.unique(np.linspace(0, len(w) - 1, WINDOWS_A_DOCUMENT).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "windows"])

    by: dict[str, list[bytes]] = {}
    for r in some.mapInArrow(run, "lang string, windows binary").distinct().collect():  # quota documents a language, about
        by.setdefault(r["lang"], []).append(bytes(r["windows"]))
    return {k: np.frombuffer(b"".join(sorted(v)), np.int16).reshape(-1, WINDOW) for k, v in sorted(by.items())}


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network fitted on windows of about `sample` of the given rows (text, lang), evenly from all languages.

    Rows without text or lang don't count, doc_id isn't read. Every lang value that stands with a text that isn't empty is learned,
    rare ones drawn as often as the others. None if no row is left.
    """
    by = sampled_windows(docs.where("text <> '' and lang is not null").select("text", "lang"), sample)
    if not by:
        return None
    rng = np.random.default_rng(3)
    x = [own[rng.integers(0, len(own), WINDOWS_A_LANGUAGE)] for own in by.values()]
    net = Network(list(by))
    if len(by) > 1:
        net.fit(np.concatenate(x), np.repeat(np.arange(len(by)), WINDOWS_A_LANGUAGE))
    return net


def predict(docs: DataFrame, net: Network | None, batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs, from its text alone.

    A null text or one without a letter gets `und` with score 0, and so does any if nothing was learned.
    Null and repeated ids pass through; whole texts are read, the long ones a block at a time. Of equal probabilities the
    first language by code point counts. An empty table gives no rows; other columns, clashing names too, aren't read.
    """

    def each(batch: pa.RecordBatch) -> dict:
        texts = batch.column(2).to_pylist()
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if net and t and _letter(t)]
        held, size = [], 0

        def flush() -> None:
            for i, p in zip(held, net.pooled([texts[i].encode("utf-8", "surrogatepass") for i in held]), strict=True):
                lang[i], score[i] = net.langs[int(p.argmax())], min(1.0, float(p.max()))
            held.clear()

        for i in todo:
            held.append(i)
            size += len(texts[i])
            if size >= batch_bytes:
                flush()
                size = 0
        if held:
            flush()
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": lang, "score": score}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), each, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(remainder("doc_id", 4) != 2)))
