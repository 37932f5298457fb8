"""Scores, fingerprints, languages, quality, tokens: against brute force, the tokenizers library, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textindex.llm import bpe, fingerprints, jaccard, language, quality, scoring, token_files
from textindex.llm.common import map_batches, shared_dir, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x y"), (3, ""), (4, " \n\t "), (5, "word " * 3000), (6, "é" * 50_000), (7, "<|endoftext|> a<|startoftext|>b"), (8, "12 34\x1c\x85\xa0　5"), (9, "it's don't\n\n  x́ ΑΣ İ ß")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r["doc_id"]: r for r in table(spark, small, "documents").collect()}


# -- 1 ----------------------------------------------------------------------------------------


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"\n"]


@pytest.mark.parametrize("known", [150_000, 600])
def test_scores(spark, small, docs, monkeypatch, known):
    monkeypatch.setattr(scoring, "TABLE", known)  # the smaller one sends most tokens through the join
    got = {r["doc_id"]: r for r in scoring.op1_lm_scores(spark, small).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(t for i, r in docs.items() if not held[i] for t in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    assert set(got) == set(docs)
    for i, r in docs.items():
        t, g = tokens(r["text"]), got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(t), sum(x in c for x in t), n)
        assert math.isclose(g["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    out = [i for i in docs if held[i]]
    assert sum(got[i]["score"] for i in out) > sum(got[i]["base_score"] for i in out) and all(g["score"] < 0 for g in got.values())


def test_scores_of_odd_texts(spark, odd, empty):
    counted = scoring.counts(odd)
    v = scoring.Vocabulary(counted)
    got = scoring.score(odd, v, counted, scoring.fit(odd, v)).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(tokens(t)) for _, t in ODD)
    nothing = scoring.counts(empty)
    v = scoring.Vocabulary(nothing)
    assert scoring.score(empty, v, nothing, scoring.fit(empty, v)).count() == 0
    assert len(scoring.score(odd, v, nothing, scoring.fit(empty, v)).collect()) == len(ODD)  # nothing learned


def slow_probability(m, v, counted, token, before, last):
    """Of one token, from the parameters, summed over everything it competes with."""
    own = {w: 1 + i for i, w in enumerate(v.known[: v.own])} | {b"\n": 0}
    get = lambda w: own[w] if w in own else v.ending.get(w[-2:], scoring.CLASSES - 1)
    a, b, k = get(before), get(last), get(token)
    hat = m.r[a] * m.p[0] + m.r[b] * m.p[1]
    e = np.exp((m.q @ hat + m.b).astype(float))
    p = float(e[k] / e.sum())
    if k < scoring.FIRST:
        return p
    words = [w for w in v.known[v.own : scoring.VECTORS] if v.ending.get(w[-2:], scoring.CLASSES - 1) == k]
    at = {w: i for i, w in enumerate(v.known)}
    members = [int(v.member[at[w]]) for w in words] + [int(v.rest[k])]
    e = [math.exp(float(m.s[b] @ m.v[j]) + float(m.d[j])) for j in members]
    if token in words:
        return p * e[words.index(token)] / sum(e)
    others = sum(c + 1 for w, c in counted.items() if get(w) == k and w not in words) + 1
    return p * e[-1] / sum(e) * (counted.get(token, 0) + 1) / others


@pytest.mark.parametrize("known, vectors", [(150_000, 65_536), (600, 450)])
def test_score_is_that_of_every_token(spark, monkeypatch, known, vectors):
    for name, x in (("TABLE", known), ("VECTORS", vectors), ("CHUNK", 70), ("BUFFER", 5000), ("TASKS", 2)):
        monkeypatch.setattr(scoring, name, x)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(2000)] + ["x" * 70]
    rows = [(i, " ".join(vocabulary[min(2000, int(rng.expovariate(0.002)))] for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(None, None), (7, "never seen " * 3)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, word int, uid int").repartition(3)
    taught = docs.where("doc_id is null or text not like 'never%'")
    table_ = scoring.counts(taught)
    v = scoring.Vocabulary(table_)
    m = scoring.fit(taught, v)
    counted = {bytes(r["word"]): r["c"] for r in table_.collect()}
    got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 3)) for r in scoring.score(docs, v, table_, m).collect())
    want = Counter()
    for i, text in rows:
        before, last, total = b"\n", b"\n", 0.0
        for t in tokens(text):
            total += math.log10(slow_probability(m, v, counted, t, before, last))
            before, last = last, t
        want[i, len(tokens(text)), round(total, 3)] += 1
    near = lambda x: sorted((str(i), n, s) for (i, n, s) in x.elements())
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.01 for a, b in zip(near(got), near(want), strict=True))
    # over all strings the probabilities add up to one: every token, and one unseen of each class of several words
    unseen = [b"\x01" + e if e else b"\x01~~" for e in [*v.ending, b""]]
    assert math.isclose(sum(slow_probability(m, v, counted, t, b"\n", tokens(rows[0][1])[0]) for t in [*counted, *unseen]), 1, rel_tol=1e-4)


def test_every_text_teaches(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(200))) for i in range(20)] + [(99, "left right " * 6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    v = scoring.Vocabulary(scoring.counts(docs))
    m = scoring.fit(docs, v)
    left, right = (1 + v.known.index(w) for w in (b"left", b"right"))
    p = 10 ** m.log10(np.array([right]), np.array([left]), np.array([right]), m.normalisers())
    assert p[0] > 0.8  # half or so by the counts alone


def sums_of_rows(ids, rows):
    by = np.argsort(ids, kind="stable")
    at = np.flatnonzero(np.diff(ids[by], prepend=-1))
    return ids[by[at]], np.add.reduceat(rows[by], at, axis=0)


def plain_training(m, context, target, rng, rate):
    """Each step as a formula of whole arrays."""
    upto, log_noise = np.cumsum(m.prior), np.log(scoring.NOISE * m.prior).astype(np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    order = rng.permutation(len(target))
    for pick in (order[i : i + scoring.BATCH] for i in range(0, len(order), scoring.BATCH)):
        a, b, t = context[pick, 0], context[pick, 1], target[pick]
        noise = np.minimum(np.searchsorted(upto, rng.random(scoring.NOISE)), scoring.CLASSES - 1)
        ra, rb, qt, qn = m.r[a], m.r[b], m.q[t], m.q[noise]
        hat = ra * m.p[0] + rb * m.p[1]
        dg = (sigmoid((hat * qt).sum(axis=1) + m.b[t] - log_noise[t]) - 1) / len(pick)
        db = sigmoid(hat @ qn.T + (m.b[noise] - log_noise[noise])) / len(pick)
        d_hat = dg[:, None] * qt + db @ qn
        g = {k: np.zeros_like(getattr(m, k)) for k in "rqb"}
        for name, ids, rows in (("q", t, dg[:, None] * hat), ("b", t, dg), ("r", a, d_hat * m.p[0]), ("r", b, d_hat * m.p[1])):
            at, sums = sums_of_rows(ids.astype(np.int16), rows)
            g[name][at] += sums
        np.add.at(g["q"], noise, db.T @ hat)
        np.add.at(g["b"], noise, db.sum(axis=0))
        g["p"] = np.stack([(d_hat * ra).sum(axis=0), (d_hat * rb).sum(axis=0)])
        for k, x in g.items():
            m.store[k] += x * x
            setattr(m, k, (getattr(m, k) - rate * x / np.sqrt(m.store[k])).astype(np.float32))


def plain_words(m, last, member, v, rng, rate):
    log_noise = np.log(scoring.WORD_NOISE * m.member_prior).astype(np.float32)
    order = rng.permutation(len(member))
    for pick in (order[i : i + scoring.WORD_BATCH] for i in range(0, len(order), scoring.WORD_BATCH)):
        a, t = last[pick], member[pick]
        of = np.repeat(v.member_class[t][:, None], scoring.WORD_NOISE, axis=1)
        drawn = np.searchsorted(v.upto, of + rng.random(of.shape), side="left")
        ids = np.c_[t, np.clip(drawn, v.starts[of - scoring.FIRST], v.starts[of - scoring.FIRST + 1] - 1)]
        x, y = m.s[a], m.v[ids]
        g = (1 / (1 + np.exp(-np.clip(np.einsum("bw,bkw->bk", x, y) + m.d[ids] - log_noise[ids], -30, 30)))).astype(np.float32)
        g[:, 0] -= 1
        back = np.einsum("bk,bkw->bw", g, y)
        rows = np.concatenate([(g[:, :, None] * x[:, None, :]).reshape(-1, scoring.WORD_WIDTH), g.reshape(-1, 1)], axis=1)
        m.met += np.bincount(ids.ravel(), minlength=len(m.met))
        at, sums = sums_of_rows(ids.ravel().astype(np.int32), rows)
        for k, where, z in (("v", at, sums[:, :-1]), ("d", at, sums[:, -1]), ("s", *sums_of_rows(a.astype(np.int16), back))):
            m.store[k][where] += z * z
            getattr(m, k)[where] -= rate * z / np.sqrt(m.store[k][where])


def test_training_costs_less_than_its_plain_steps(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(40_000)]
    texts = [" ".join(words[int(40_000 ** rng.random()) - 1] for _ in range(400)) for _ in range(250)]
    v = scoring.Vocabulary(scoring.counts(spark.createDataFrame([(x,) for x in texts], "text string")))
    pos = scoring.Positions(texts, v, v.lookup(), v.classes())
    context, several = np.stack([pos.before, pos.last], axis=1), pos.member >= 0
    last, member = pos.last[several], pos.member[several]
    assert len(member) > 2 * scoring.WORD_BATCH  # whole batches
    took, models = {}, {}
    for _ in range(3):
        for name, train, train_words in (("plain", plain_training, plain_words), ("own", scoring.LogBilinear.train, scoring.LogBilinear.train_words)):
            m, r = scoring.LogBilinear(v.prior, v.member_prior), np.random.default_rng(4)
            began = time.thread_time()
            train(m, context, pos.seq, r, 0.08)
            train_words(m, last, member, v, r, 0.2)
            took.setdefault(name, []).append(time.thread_time() - began)
            models[name] = m
    for k in ("r", "q", "p", "b", "s", "v", "d", "met"):  # the same model, whatever it costs
        assert np.allclose(getattr(models["own"], k), getattr(models["plain"], k), rtol=0, atol=1e-4), k
    assert min(took["own"]) < 0.85 * min(took["plain"]), took


# -- 3 ----------------------------------------------------------------------------------------


def slow_hashes(text, k=fingerprints.K):
    out, m = [], 1 << 64
    k = min(k, len(text))
    for i in range(len(text) - k + 1):
        h = 0
        for ch in text[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + ord(ch)) % m
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % m
        h = (h ^ h >> 27) * 0x94D049BB133111EB % m
        out.append((h ^ h >> 31) >> 32)
    return out


def slow_winnow(text, w=fingerprints.WINDOW):
    if not text:
        return ""
    h, chosen = slow_hashes(text), set()
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        chosen.add(i + max(j for j, x in enumerate(part) if x == min(part)))
    return " ".join(f"{p}:{h[p]:08x}" for p in sorted(chosen))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé😀 ", max_size=300), st.integers(1, 200))
def test_winnowing(text, step):
    kept, fingerprints.STEP = fingerprints.STEP, step
    try:
        assert fingerprints.written(*fingerprints.winnow(text)) == slow_winnow(text)
    finally:
        fingerprints.STEP = kept


def test_shared_runs_are_found():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    run = text(fingerprints.K + fingerprints.WINDOW - 1)
    a, b = (fingerprints.winnow(text(200) + run + text(300))[1] for _ in range(2))
    assert len(np.intersect1d(a, b))


@pytest.mark.parametrize("parts", [1, 4])
def test_pairs(spark, small, docs, parts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(table(spark, small, "documents"), parts).collect()}
    ids = sorted(docs)
    assert sorted(got) == ids
    for i, follower in zip(ids, ids[1:] + ids[:1], strict=True):
        t, f = docs[i]["text"], docs[follower]["text"]
        e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        if i % 10 == 0:
            assert got[i]["fingerprint"] == slow_winnow(t) and got[i]["edited_fingerprint"] == slow_winnow(e)
        sets = [{x.split(":")[1] for x in r.split()} for r in (got[i]["fingerprint"], got[i]["edited_fingerprint"], got[follower]["fingerprint"])]
        assert math.isclose(got[i]["near_edited"], len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert math.isclose(got[i]["near_next"], len(sets[0] & sets[2]) / len(sets[0] | sets[2]))


def test_pairs_of_odd_texts(odd, empty, spark):
    for parts in (1, 3):
        rows = fingerprints.fingerprint_pairs(odd, parts).collect()
        assert sorted(r["n_chars"] for r in rows) == sorted(len(t or "") for _, t in ODD)
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    one = fingerprints.fingerprint_pairs(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).first()
    assert (one["fingerprint"], one["near_edited"], one["near_next"]) == ("", 1.0, 1.0)


# -- 5 ----------------------------------------------------------------------------------------


def test_languages(spark, small, docs):
    got = language.op5_language(spark, small).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) > 0.95 * len(held)


def slow_pooled(net, data):
    """Mean probabilities of a text, one position and one gate at a time."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    h, total = language.HIDDEN, [0.0] * len(net.langs)
    for a in range(0, len(data), language.WINDOW):
        x = list(data[a : a + language.WINDOW]) + [language.PAD] * (language.WINDOW - len(data[a : a + language.WINDOW]))
        states = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            s, states[d] = [0.0] * h, {}
            for t in order:
                i = net.w[f"e{d}"][x[t]].tolist()
                r = [sum(s[j] * float(net.w[f"u{d}"][j][k]) for j in range(h)) for k in range(3 * h)]
                z = [sigmoid(i[k] + r[k]) for k in range(h)]
                q = [sigmoid(i[h + k] + r[h + k]) for k in range(h)]
                new = [math.tanh(i[2 * h + k] + q[k] * r[2 * h + k]) for k in range(h)]
                s = [(1 - z[k]) * new[k] + z[k] * s[k] for k in range(h)]
                states[d][t] = s
        for t in range(min(len(x), len(data) - a)):
            e = [math.exp(float(net.w["c"][l]) + sum(states["f"][t][k] * float(net.w["of"][k][l]) + states["b"][t][k] * float(net.w["ob"][k][l]) for k in range(h))) for l in range(len(net.langs))]
            total = [v + w / sum(e) for v, w in zip(total, e, strict=True)]
    return [v / len(data) for v in total]


def test_pooled_probabilities_equal_a_plain_network(spark, docs):
    net = language.train(spark.createDataFrame([(r["text"], r["lang"]) for r in docs.values()], "text string, lang string"))
    texts = ["a", "Ünï ÷ 中 x", *(r["text"][:150] for r in list(docs.values())[:4] if r["text"])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language.predict(rows, net).collect()}
    for i, t in enumerate(texts):
        want = slow_pooled(net, t.encode())
        assert got[i]["lang_pred"] == net.langs[int(np.argmax(want))] and math.isclose(got[i]["score"], max(want), abs_tol=1e-4)


def test_rare_languages_are_learned(spark):
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(text("abcdef"), "common")] * 400 + [(text("abcdef"), "common") for _ in range(3000)] + [(text("uvwxyz") * 40, "rare"), (text("лмнопр") * 400, "long"), ("", "empty"), (None, "none"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    by = language.sampled_windows(docs.where("text <> '' and lang is not null"), 300)
    assert set(by) == {"common", "rare", "long"} and 60 * language.WINDOWS_A_DOCUMENT < len(by["common"]) < 140 * language.WINDOWS_A_DOCUMENT
    net = language.train(docs, 300)
    asked = spark.createDataFrame([(1, text("abcdef")), (2, text("uvwxyz")), (3, text("лмнопр")), (4, "1 2"), (5, text("uvwxyz") * 3000)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(asked, net).collect()} == {1: "common", 2: "rare", 3: "long", 4: "und", 5: "rare"}


def test_gradients():
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (4, language.WINDOW)), rng.integers(0, 3, 4)
    _, g = net.gradients(x, y)
    for k, w in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = w[at]
        sides = []
        for d in (1e-2, -1e-2):
            w[at] = old + d
            sides.append(net.gradients(x, y)[0])
        w[at] = old
        assert math.isclose((sides[0] - sides[1]) / 2e-2, g[k][at], rel_tol=0.05)


def test_languages_of_odd_texts(spark, odd, empty):
    none = language.train(empty.selectExpr("doc_id", "text", "text AS lang"))
    assert none is None
    one = language.train(odd.selectExpr("doc_id", "text", "'xx' AS lang"))
    for net, name in ((none, "und"), (one, "xx")):
        rows = language.predict(odd, net).collect()
        assert len(rows) == len(ODD)
        letters = {i for i, t in ODD if t and any(ch.isalpha() for ch in t)}
        assert all(r["lang_pred"] == (name if r["doc_id"] in letters else "und") for r in rows)
    assert language.predict(empty, one).count() == 0


# -- 6 ----------------------------------------------------------------------------------------


def slow_base(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x1c\x85", max_size=120))
def test_base_counts(text):
    assert quality.statistics(text)[0] == slow_base(text)


def test_quality(spark, small, docs):
    rows = quality.op6_quality(spark, small).collect()
    assert len(rows) == len(docs)
    label = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    for r in rows:
        base = slow_base(docs[r["doc_id"]]["text"])
        assert [r[k] for k in quality.BASE] == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r["base_failed"] and r["kept"])
    judged = [r for r in rows if not r["base_failed"] and r["doc_id"] in label]
    assert sum(r["kept"] == bool(label[r["doc_id"]]) for r in judged) >= 0.97 * len(judged)


def test_verdicts_are_walks_down_the_trees(spark, small, docs):
    all_docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    forest = quality.train(all_docs, labels)
    for r in quality.judge(all_docs, forest).collect():
        counts, features = quality.statistics(docs[r["doc_id"]]["text"])
        total = forest.base
        for k in forest.roots.tolist():
            while forest.left[k] != k:
                k = forest.left[k] if features[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            total += forest.value[k]
        score = 1 / (1 + math.exp(-total))
        assert math.isclose(r["quality_score"], score, rel_tol=1e-9)
        assert r["kept"] == (counts[0] >= 50 and 100 * counts[4] <= 50 * counts[0] and score >= quality.KEEP_FROM)


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.2, 600) > 0.6).astype(float)
    forest = quality.fit(x, y, np.array([1, 0]), trees=30)
    grid = np.stack([np.linspace(-1, 2, 200), np.full(200, 0.4)], axis=1)
    assert (np.diff(forest.score(grid)) >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    only = quality.fit(x, np.ones(600), np.array([1, 0]))
    assert np.ptp(only.score(x)) == 0


def test_quality_of_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 0), (None, 1), (6, None)], "doc_id bigint, quality int")
    forest = quality.train(odd, labels)
    rows = quality.judge(odd, forest).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows if r["n_words"] < 50)
    assert quality.judge(empty, quality.train(empty, labels)).count() == 0
    wide = odd.selectExpr("text", "doc_id", "1 AS kept", "2 AS n_words", "'q' AS features")
    kept = quality.filter_quality(wide, labels)
    assert kept.columns == wide.columns and kept.count() == sum(r["kept"] for r in rows)


# -- 8 and 9 ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers_():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.default_path()), Tokenizer.from_file(bpe.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ALPHABET = " \n\t'sterdé<|>end12,.!\xa0　\x1c\x85😀İßΣςé́\r"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=40), st.text(max_size=20).filter(lambda t: "\x00" not in t), st.sampled_from(["<|endoftext|> a", "b<|startoftext|>", "don't 've''s"])), max_size=4))
def test_tokens_equal_the_library(tokenizers_, texts):
    words, byte_level = tokenizers_
    c = bpe.codec(bpe.default_path())
    for coder, library in ((token_files.encoder(token_files.default_path()), words), (c, byte_level)):
        ids, n = coder.encode(pa.array([*texts, None], pa.string()))
        want = [ids_of(library, t) for t in [*texts, None]]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert [x.decode() for x in c.decode(ids, n)] == [byte_level.decode(x, skip_special_tokens=False) for x in want]


def test_tokens_when_the_worker_forgets(tokenizers_, docs, monkeypatch):
    words, byte_level = tokenizers_
    texts = [r["text"] for r in docs.values()][:60]
    monkeypatch.setattr(bpe, "KEEP", 20_000)
    monkeypatch.setattr(token_files, "KEEP", 300)
    for coder, library in ((token_files.WordEncoder(token_files.default_path()), words), (bpe.Codec(bpe.default_path()), byte_level)):
        for i in range(0, len(texts), 7):
            ids, n = coder.encode(pa.array(texts[i : i + 7], pa.string()))
            assert ids.tolist() == [k for t in texts[i : i + 7] for k in ids_of(library, t)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=1300), st.sampled_from([1, 7, 200, 2**16, 2**32]))
def test_blocks_round_trip(ids, under):
    ids = np.array([i % under for i in ids], np.uint32)
    raw = token_files.file_bytes([7, None], [len(ids), 0], ids)
    who, lengths, back = token_files.read_file(raw)
    assert who == [7, None] and lengths.tolist() == [len(ids), 0] and (back == ids).all()


def test_slices_read_their_blocks_only():
    ids = np.random.default_rng(2).integers(0, 49_000, 7000).astype(np.uint32)
    raw = token_files.file_bytes([1, None, 3], [6000, 0, 1000], ids)

    class Counted:
        n = 0

        def read_at(self, n, at):
            self.n += n
            return raw[at : at + n]

    for start, n in ((0, 7000), (511, 2), (512, 512), (6990, 50), (7000, 1), (3000, 0)):
        f = Counted()
        assert (token_files.read_slice(f, start, n) == ids[start : start + n]).all()
        assert n > 600 or f.n < 3000


def test_token_files(spark, small, docs, tokenizers_, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    folder = shared_dir(spark, "test")
    files = token_files.write_files(table(spark, small, "documents"), folder, parts=3)
    got = {r["doc_id"]: r for r in token_files.read_files(files, folder).collect()}
    start = 0
    for i in sorted(docs):
        ids = [*ids_of(tokenizers_[0], docs[i]["text"]), 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert files.count() > 3


def test_token_files_of_odd_texts(spark, odd, empty, tokenizers_):
    folder = shared_dir(spark, "test")
    rows = token_files.read_files(token_files.write_files(odd, folder, parts=2), folder).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(ids_of(tokenizers_[0], t)) + 1 for _, t in ODD)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.read_files(token_files.write_files(empty, folder), folder).count() == 0


def test_byte_pairs(spark, small, docs, tokenizers_, odd, empty):
    lib = tokenizers_[1]
    for rows, texts in ((bpe.op9_bpe(spark, small).collect(), [(i, r["text"]) for i, r in docs.items()]), (bpe.digests(odd).collect(), ODD)):
        want = []
        for i, t in texts:
            ids = ids_of(lib, t)
            want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in rows) == sorted(want)
    assert bpe.digests(empty).count() == 0
    assert {r["decoded"] for r in bpe.encode_decode(odd).collect()} == {t or "" for _, t in ODD}


# -- memory of the workers ---------------------------------------------------------------------


def test_a_worker_gives_back_what_it_freed(spark):
    """An idle worker counts to its executor, so a task's end must not leave freed memory with the C library."""
    own = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10
    pins = []

    def each(batch):
        some = [bytes(1000) for _ in range(150_000)]
        pins.append(some[-1])  # what stays in use behind the rest
        return {"doc_id": batch.column(0)}

    run = map_batches(SimpleNamespace(mapInArrow=lambda run, schema: run), each, "doc_id bigint")
    jaccard._hashes[b"word"]  # noqa: B018
    before = own()
    assert sum(x.num_rows for x in run(iter([pa.record_batch({"doc_id": pa.array([1, 2], pa.int64())})]))) == 2
    assert own() - before < 50 and not jaccard._hashes
