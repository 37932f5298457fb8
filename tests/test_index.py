"""Golden texts, definitions, round trips and the equality of all forms of the index operators."""

from __future__ import annotations

import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textindex.functions.text import count_pattern, longest_repeat, match_length
from textindex.operators import kernels as K
from textindex.operators import large, local, neighbours, suffix, transform
from textindex.sources import corpus as sources
from textindex.sources.corpus import from_strings, symbols

# Texts with their suffix array, transform, primary index and factors.
GOLDEN = {
    b"BANANA": ([5, 3, 1, 0, 4, 2], b"ANNBAA", 4, [(66, 0), (65, 0), (78, 0), (1, 3)]),
    b"MISSISSIPPIMISSISSIPPI": ([21, 10, 18, 7, 15, 4, 12, 1, 11, 0, 20, 9, 19, 8, 17, 6, 14, 3, 16, 5, 13, 2], b"IPPSSSSMMIPPIISSSSIIII", 10, [(77, 0), (73, 0), (83, 0), (2, 1), (1, 4), (80, 0), (8, 1), (7, 1), (0, 11)]),
    b"BANANA_BANANA": ([12, 10, 8, 1, 3, 5, 7, 0, 11, 9, 2, 4, 6], b"ANNBBNN_AAAAA", 8, [(66, 0), (65, 0), (78, 0), (1, 3), (95, 0), (0, 6)]),
    b"a" * 16: ([15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0], b"a" * 16, 16, [(97, 0), (0, 15)]),
    b"ACGTACGTACGTTTACGA": ([17, 14, 0, 4, 8, 15, 1, 5, 9, 16, 2, 6, 10, 13, 3, 7, 12, 11], b"AGTTTAAAACCCCTGGTG", 3, [(65, 0), (67, 0), (71, 0), (84, 0), (0, 8), (11, 2), (0, 3), (14, 1)]),
    b"a\0\0": ([2, 1, 0], None, None, [(97, 0), (0, 0), (1, 1)]),
    b"\xff\0\xff": ([1, 2, 0], None, None, [(255, 0), (0, 0), (0, 1)]),
    b"ab\0ab": ([2, 3, 0, 4, 1], None, None, [(97, 0), (98, 0), (0, 0), (0, 2)]),
}


def some_texts() -> list[bytes]:
    rng = random.Random(5)
    alphabets = (b"\0\1\2", b"\0\1\xff", b"ab", b"ACGT", bytes(range(97, 123)))
    return [*GOLDEN, b"", b"A", b"\0\0", "ñandú ñu".encode(), *(bytes(rng.choice(a) for _ in range(rng.randint(0, 64))) for a in alphabets for _ in range(25))]


def by_definition(t: bytes) -> list[int]:
    return sorted(range(len(t)), key=lambda i: t[i:])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(some_texts())], "doc_id bigint, bytes binary").repartition(3)


def arrays(rows) -> dict[int, list[int]]:
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["doc_id"], {})[r["rank"]] = r["pos"]
    return {d: [x[i] for i in range(len(x))] for d, x in out.items()}


@pytest.mark.parametrize("form", ["naive", "doubling", "fast", "local"])
def test_suffix_arrays(corpus, form):
    want = {i: by_definition(t) for i, t in enumerate(some_texts()) if t}
    assert arrays(suffix.suffix_array(corpus, form).collect()) == want


def test_large_texts_take_the_distributed_form(corpus):
    want = {i: by_definition(t) for i, t in enumerate(some_texts()) if t}
    assert arrays(suffix.suffix_array(corpus, large=20).collect()) == want


def test_large_texts_in_blocks(corpus, monkeypatch):
    monkeypatch.setattr(large, "ASKS", 3)  # several copies of a block that more rows look into
    got = large.neighbours(corpus, large=20, block=5)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, local.psv_nsv(corpus).select(*got.columns).collect()))
    want = {i: by_definition(t) for i, t in enumerate(some_texts()) if t}
    got = {}
    for r in large.transform(corpus, large=20).collect():
        got.setdefault(r["doc_id"], {})[r["place"]] = r["byte"]
    assert {d: bytes(x[i] for i in range(len(x))) for d, x in got.items()} == {i: some_texts()[i][-1:] + bytes(some_texts()[i][p - 1] for p in sa if p) for i, sa in want.items()}


def test_positions_by_chunks(corpus, monkeypatch):
    monkeypatch.setattr(sources, "CHUNK", 5)
    want = sorted((i, p, t[p : p + 8]) for i, t in enumerate(some_texts()) for p in range(len(t)))
    for spread in (False, True):
        assert sorted((r["doc_id"], r["pos"], bytes(r["key"])) for r in sources.prefixes(corpus, 8, spread).collect()) == want
    counts = Counter(b"".join(some_texts()))
    assert {r["byte"]: r["n"] for r in sources.byte_counts(corpus).collect()} == counts


def test_memory_bounds_what_a_task_indexes(spark):
    assert suffix.large_from(spark) >= 1 << 16
    with_conf = lambda master, **c: suffix.large_from(type("S", (), {"sparkContext": type("C", (), {"master": master}), "conf": type("G", (), {"get": staticmethod(lambda k, d=None: c.get(k.replace(".", "_"), d))})}))
    assert with_conf("yarn", spark_executor_cores="4", spark_executor_pyspark_memory="8g") == (1 << 30) // 160
    assert with_conf("yarn", spark_executor_cores="4", spark_executor_memoryOverhead="4096") == (512 << 20) // 160
    assert with_conf("yarn", spark_executor_memory="40g") == (2 << 30) // 160
    assert with_conf("local[4]") == (512 << 20) // 160


def test_common_prefixes_of_neighbours(corpus):
    got = {}
    for r in local.lcp(corpus).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = r["lcp"]
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for i, t in enumerate(some_texts()):
        sa = by_definition(t)
        assert [got[i][r] for r in range(len(t))] == [same(t[sa[r - 1] :], t[sa[r] :]) if r else 0 for r in range(len(t))] if t else i not in got


def test_golden():
    for text, (sa, l, primary, factors) in GOLDEN.items():
        b = K.Batch([text])
        got, isa = K.suffix_array(b)
        assert got.tolist() == sa and [sa[i] for i in isa] == list(range(len(sa)))
        if l is not None:
            made, at = K.bwt(b, got, isa)
            assert made == [l] and at.tolist() == [primary]
        _, _, source, length = K.factors(b)
        assert list(zip(source.tolist(), length.tolist(), strict=True)) == factors


def test_skew_and_doubling_are_the_same():
    texts = [*some_texts(), b"a" * 3000, b"ab" * 2000 + b"c" + b"ab" * 2000, b"abracadabra" * 500]
    b = K.Batch(texts)
    sa = K.skew(b)
    for k, t in enumerate(texts):
        assert (sa[b.starts[k] : b.ends[k]] - b.starts[k]).tolist() == by_definition(t)
    assert K.same(b, sa, K.suffix_array(b)[0]).all()
    other = sa.copy()
    last = next(k for k in range(len(texts) - 1, -1, -1) if b.sizes[k] > 1)
    for k in (0, last):
        other[[b.starts[k], b.starts[k] + 1]] = other[[b.starts[k] + 1, b.starts[k]]]
    assert np.flatnonzero(~K.same(b, sa, other)).tolist() == [0, last]
    wide = np.random.default_rng(3).integers(1, 1 << 21, 30_000)
    wide[15_000:] = wide[:15_000]  # values too large for a triple in one number; of two equal ones the shorter suffix comes first
    v = wide.tolist()
    assert K._by_thirds(wide).tolist() == sorted(range(len(v)), key=lambda i: (v[i : i + 4], i < 15_000))


def test_verification_makes_no_row_for_a_position(spark, corpus):
    twice = corpus.union(corpus.where("doc_id = 3"))  # a repeated id is a row of its own
    got = suffix.verify(twice)
    assert "Aggregate" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan and "Window" not in plan
    want = sorted([*(i for i, t in enumerate(some_texts()) if t), 3])
    assert sorted(r["doc_id"] for r in got.where("match").collect()) == want
    assert sorted(r["doc_id"] for r in suffix.verify(corpus, large=20).where("match").collect()) == sorted(set(want))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\0c", max_size=40), max_size=5))
def test_kernels_on_any_texts(texts):
    texts = [t.encode() for t in texts]
    b = K.Batch(texts)
    sa, isa = K.suffix_array(b)
    l, primary = K.bwt(b, sa, isa)
    owner, _, source, length = K.factors(b)
    for k, t in enumerate(texts):
        s, e = int(b.starts[k]), int(b.ends[k])
        own = (sa[s:e] - s).tolist()
        assert own == by_definition(t)
        assert K.unbwt(l[k], int(primary[k])) == t
        mine = owner == k
        assert K.decode(source[mine].tolist(), length[mine].tolist()) == t
        at = 0
        for m in length[mine].tolist():  # no factor could be longer
            n = max(1, m)
            assert t.find(t[at : at + m + 1]) == at or at + m == len(t)
            at += n


def test_long_repeats_end(spark):
    for t in (b"a" * 200_000, b"ab" * 50_000 + b"c" + b"ab" * 50_000):
        _, _, source, length = K.factors(K.Batch([t]))
        assert K.decode(source.tolist(), length.tolist()) == t and len(length) <= 5


def test_neighbours(corpus):
    rows = {(r["doc_id"], r["rank"]): r for r in local.psv_nsv(corpus).collect()}
    for i, t in enumerate(some_texts()):
        sa = by_definition(t)
        for r, p in enumerate(sa):
            before = next((j for j in range(r - 1, -1, -1) if sa[j] < p), None)
            after = next((j for j in range(r + 1, len(sa)) if sa[j] < p), None)
            got = rows[i, r]
            assert (got["psv_rank"], got["nsv_rank"]) == (before, after)
            assert (got["psv"], got["nsv"]) == (None if before is None else sa[before], None if after is None else sa[after])


def test_neighbours_by_join_are_the_same(corpus):
    columns = ["doc_id", "rank", "pos", "psv", "nsv", "psv_rank", "nsv_rank"]
    a, b = local.psv_nsv(corpus).select(columns), neighbours.by_join(suffix.naive(corpus)).select(columns)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_transform(corpus):
    texts = some_texts()
    a = {r["doc_id"]: (r["l_hex"], r["primary_index"]) for r in transform.bwt(corpus, suffix.naive(corpus)).collect()}
    b = {r["doc_id"]: (bytes(r["l"]).hex().upper(), r["primary_index"]) for r in local.bwt(corpus).collect()}
    assert a == b and set(a) == {i for i, t in enumerate(texts) if t}
    back = {r["doc_id"]: bytes(r["bytes"]) for r in local.unbwt(local.bwt(corpus)).collect()}
    assert back == {i: t for i, t in enumerate(texts) if t}
    aux = {(r["doc_id"], r["k"]): r["i"] for r in transform.bwt_aux(suffix.naive(corpus), 8).collect()}
    assert [aux[1, k] for k in range(3)] == [10, 14, 19]
    with pytest.raises(ValueError):
        transform.bwt_aux(suffix.naive(corpus), 6)


def test_factors_round_trip(corpus):
    texts = some_texts()
    coded = local.lz_encoded(corpus)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in local.lz_decoded(coded).collect()} == dict(enumerate(texts))
    first = coded.where("doc_id = 0").first()
    assert bytes(first["factors"]) == b"".join(struct.pack("<QQ", *f) for f in GOLDEN[b"BANANA"][3]) and first["phrases"] == 4


def test_verification_finds_a_difference(spark, corpus):
    a = suffix.naive(corpus)
    assert suffix.compare(a, suffix.fast(corpus)).where("not match").isEmpty()
    other = a.selectExpr("doc_id", "rank", "case when doc_id = 0 and rank < 2 then 1 - rank else pos end as pos")
    assert [r["doc_id"] for r in suffix.compare(a, other).where("not match").collect()] == [0]


def test_functions(spark):
    rows = spark.createDataFrame([(1, bytearray(b"banana"), 3, 1), (2, bytearray(b"banana"), None, 1), (3, bytearray(b"aaaa"), 0, 1)], "doc_id bigint, bytes binary, i bigint, j bigint")
    assert [r[0] for r in rows.select(match_length("bytes", "i", "j")).collect()] == [3, None, 3]
    assert [r[0] for r in rows.select(longest_repeat("bytes")).collect()] == [3, 3, 3]
    assert [r[0] for r in rows.select(count_pattern(b"an")("bytes")).collect()] == [2, 2, 0]


def test_symbols_are_bytes(spark):
    rows = symbols(from_strings(spark.createDataFrame([(1, "é"), (2, ""), (3, None)], "a int, b string"), "a", "b")).collect()
    assert sorted((r["doc_id"], r["pos"], r["byte"]) for r in rows) == [(1, 0, 195), (1, 1, 169)]
