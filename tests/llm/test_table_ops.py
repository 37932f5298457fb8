"""Mixing, archives, the Jaccard join, line dedup and the pipeline: against SQL, brute force, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textindex.llm import jaccard, lines, mixing, registry, warc
from textindex.llm.common import range_bounds, range_of, shared_dir, shared_table, table
from textindex.llm.components import components


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, small), con.sql(registry.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


# -- 2 ----------------------------------------------------------------------------------------


def test_targets_share_out_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 100}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weights = {"a": 3, "b": 1, "c": 2, None: 3}
    goal, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * share > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
        free -= over
        left = 1.5 * sum(sizes.values()) - sum(goal.values())
    goal |= {s: weights[s] * share for s in free}
    assert got == pytest.approx(goal)


def test_mixing_takes_each_budget(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40), rng.choice(["hot", "hot", "hot", "b", None, "ß"]), rng.choice([None, 0, 1, 5, 90]), i) for i in range(3000)] + [(None, "b", 3, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, taken int").repartition(5)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    assert len(out) == len(rows) and sorted(map(repr, out)) == sorted(map(repr, again))
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in out:
        assert 0 <= r["taken"] <= 2 * (r["size"] or 0)
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] += r["size"] or 0
    assert all(abs(taken - target) <= 1 and target <= 2 * size for taken, target, size in by.values())
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * sum(x[2] for x in by.values()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.where("coalesce(size, 0) = 0")).collect())


# -- 4 ----------------------------------------------------------------------------------------


def test_records_round_trip_and_damage_shows():
    raw = warc.record(5, "http://a.b/c\r\nX: y", b"<p>\r\n\r\nhi</p>", hashlib.sha256(b"<p>\r\n\r\nhi</p>").hexdigest(), None)
    got = warc.parse(raw)
    assert (got["page_id"], got["payload"], got["record_type"], got["payload_bytes"]) == (5, b"<p>\r\n\r\nhi</p>", "response", 13)
    with pytest.raises(ValueError):
        warc.parse(warc.record(5, None, b"hi", "00", None))


def test_archives_of_odd_pages(spark):
    big = "x" * 500_000
    rows = [(3, "u", big), (1, None, big), (2, "v", big), (1, "w", big), (7, "a", None), (8, "b", ""), (9, "c", "short"), (10, "d", "short"), (None, "e", big), (None, "f", "é" * 50), (11, "g", "é" * 50)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, offset int, digest string").repartition(3)
    folder = shared_dir(spark, "test")
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder, span=1000, gap=10).collect()
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        refers = min(same) if len(data) >= 100 and same and page != min(same) and len([1 for r in rows if (r[2] or "") == (html or "")]) > 1 else None
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    some = warc.read_records(index.where("page_id = 9 OR page_id = 3"), folder).collect()
    assert sorted((r["page_id"], r["payload"]) for r in some) == [(3, None), (9, b"short")]
    assert warc.read_records(warc.write_archives(pages.limit(0), folder), folder).count() == 0


# -- 7 ----------------------------------------------------------------------------------------


def words_of(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def parts_of(sets, percent):
    part = list(range(len(sets)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    return find


def slow_groups(rows, n=4, percent=85):
    sets = [words_of(text, n) for _, text in rows]
    find = parts_of(sets, percent)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_copies(seed, groups=6, size=25):
    """Texts in groups: drifting copies of one, each a few words off another of the group."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        family = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 60, 200]))]]
        for _ in range(size):
            t = list(rng.choice(family))
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            family.append(t)
        rows += [" ".join(t) for t in family]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, block", [(1, 1_000_000), (2, 2000)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)  # the smaller one cuts groups into pairs of blocks
    monkeypatch.setattr(jaccard, "ROWS", 8)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    rows = near_copies(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1004, "a b"), (None, "a b"), (None, "lone text of no id"), (1005, "one " * 400)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, node int").repartition(4)
    got = sorted((tuple(r) for r in jaccard.groups(docs).collect()), key=repr)
    assert got == slow_groups(rows)
    if block == 2000:
        got = sorted((tuple(r) for r in jaccard.groups(docs, 5, 80).collect()), key=repr)
        assert got == slow_groups(rows, 5, 80)
    assert sorted((tuple(r) for r in jaccard.one_of_each(docs).collect()), key=repr) == sorted(((*r, 1) for r in slow_one_of_each(rows)), key=repr)


def slow_one_of_each(rows, n=4, percent=85):
    """Of each group the row of the least id (null last), of equal rows one; rows without words all stay. For ids that repeat the hash decides, so only use it where the rows of a group's least id are equal."""
    sets = [words_of(t, n) for _, t in rows]
    part = parts_of(sets, percent)
    out = [r for r, s in zip(rows, sets, strict=True) if not s]
    for p in {part(i) for i, s in enumerate(sets) if s}:
        out.append(min((rows[i] for i, s in enumerate(sets) if s and part(i) == p), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def test_one_of_each_tells_rows_apart(spark):
    x, y, z = ("one two three four five six seven", "eight nine ten eleven twelve", "red green blue white black grey")
    rows = [(3, x), (5, x), (5, y), (7, ""), (7, z), (7, ""), (None, y), (None, "something else that no other row has"), (None, None), (9, z), (11, "word"), (11, "word"), (11, "word")]
    schema = "doc_id bigint, text string, root string, node int, tags map<string,int>, `__key` int"
    docs = spark.createDataFrame([(*r, "r", 1, {"a": 1}, None) for r in rows], schema).repartition(3)
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(3, x), (5, y), (7, ""), (7, ""), (7, z), (None, "something else that no other row has"), (None, None), (11, "word")], key=repr)
    assert {(r["root"], r["node"], r["tags"]["a"]) for r in got} == {("r", 1, 1)}
    unlike = spark.createDataFrame([(1, x, 1), (1, x, 2), (1, x, 2)], "doc_id bigint, text string, more int")
    assert len(jaccard.one_of_each(unlike.repartition(3)).collect()) == 1


def test_a_large_group_in_blocks(spark, monkeypatch, size=2000):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 100)
    monkeypatch.setattr(jaccard, "ROWS", 32)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(size):
        t = list(base)
        t[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert [tuple(r) for r in jaccard.groups(docs).orderBy("doc_id").collect()] == [(i, 117, 0) for i in range(size)]


def test_groups_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert jaccard.groups(none).count() == 0 and jaccard.one_of_each(none).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(-50, 90), rng.randint(-50, 90)) for _ in range(60)] + [(5, 5), (5, 6), (5, 6), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got.get(n, n) == min(seen)


def test_kept_grams_are_enough():
    for n in range(1, 400):
        for m in range(n, int(n / 0.85) + 2):
            for both in range(1, n + 1):
                if 100 * both >= 85 * (n + m - both):
                    # at worst the sets differ in what comes first
                    kept = min(jaccard.kept_length(n) - (n - both), jaccard.kept_length(m) - (m - both))
                    assert kept >= jaccard.shared_at_least(n) or kept >= both
                    assert jaccard.shared_at_least(n) >= 1 + -(-85 * m // 100) // 20 or n < -(-85 * m // 100)
                    break


# -- 10 ---------------------------------------------------------------------------------------


def slow_dedup(rows):
    occurs, leaves = defaultdict(set), defaultdict(set)
    mask = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(ws := mask(line)) >= 4:
                occurs[ws].add(d)
                leaves[len(ws), ws[:3]].add(ws)
    gone = {(d, ws) for ws, s in occurs.items() if len(s) >= 2 for d in s if d != min(s)}
    holders, members = defaultdict(set), defaultdict(set)
    for leaf, all_ws in leaves.items():
        if leaf[0] < 6 or len(all_ws) < 2 or sum(len(occurs[w]) for w in all_ws) < 5:
            continue
        n = defaultdict(int)
        for ws in all_ws:
            for cell in enumerate(ws[3:]):
                n[cell] += len(occurs[ws])
        for ws in all_ws:
            constant = tuple(c for c in enumerate(ws[3:]) if n[c] >= 5)
            if constant and 100 * (3 + len(constant)) >= 70 * len(ws):
                holders[leaf, constant] |= occurs[ws]
                members[leaf, constant].add(ws)
    for t, s in holders.items():
        if len(s) >= 5:
            gone |= {(d, ws) for ws in members[t] for d in occurs[ws] if d != min(s)}
    out = []
    for d, text in rows:
        if text is None:
            out.append((d, None, 0, 0))
            continue
        raw = text.split("\n")
        kept = [x for x in raw if (d, mask(x)) not in gone]
        out.append((d, "\n".join(kept), len(raw), len(raw) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng, rows = random.Random(6), []
    for i in range(120):
        own = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 12))) for _ in range(4)]
        own.append(f"the user {rng.choice('xyzuvw')}{rng.choice('pqrst')} has logged in at {i} o'clock today")
        if i % 3:
            own.append("all rights are reserved by us")
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "all rights are reserved by us"), (204, "x y z " * 20_000)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id bigint, text string, line int, n_lines string").repartition(4)
    got = lines.dedup(docs)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_dropped"]
    got = sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    want = slow_dedup(rows)
    assert got == want
    assert sum(r[3] for r in want) > 150
    assert lines.dedup(docs.limit(0)).count() == 0


def test_repeated_rows_of_lines_end_alike(spark):
    rows = [(1, "a line of four\nown words of this one"), (1, "a line of four\nown words of this one"), (None, "a line of four"), (None, None)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(*rows[0], 2, 0), (*rows[1], 2, 0), (None, "", 1, 1), (None, None, 0, 0)], key=repr)


def test_common_values_of_fields_make_no_templates(spark):
    names, cities = [f"name{c}" for c in "abcdefgh"], [f"city{c}" for c in "abcdefgh"]
    pairs = [(n, c) for n in names for c in cities]  # 64 lines in one document each, a value in 8 documents
    rows = [(i, f"Posted by the editor {n} from {c} in our newsroom today") for i, (n, c) in enumerate(pairs)]
    rows += [(100 + i, f"Posted by the reader {n} at noon with thanks to everybody here") for i, n in enumerate(names)]  # another template of the leaf
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).where("n_dropped = 0").collect()
    assert sorted(r["doc_id"] for r in got) == [0, 100]


def test_rows_of_numbers_stay(spark):
    rows = [(i, f"10{i} 20{i} 3.{i} 40{i}\n{i}1 {i}2 {i}3 total\n{i}1 {i}2 {i}3 {i}4 {i}5 {i}6\nsums {i}1 {i}2 {i}3 {i}4 {i}5") for i in range(8)]
    rows += [(20, "1 2 3 4 5 6\nown words of this one"), (21, "1 2 3 4 5 6")]  # the same row of numbers twice
    rows += [(30 + i, f"taken at noon by us on day {i}") for i in range(6)]  # a template with a field
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).where("n_dropped > 0").collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(21, 1), *((30 + i, 1) for i in range(1, 6))]


# -- the pipeline -------------------------------------------------------------------------------


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    columns, counts = docs.columns, [docs.count()]
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared_table(stage(spark, docs, small), "test", spark)
        counts.append(docs.count())
        by[name] = (before, docs)
        if name != "encoded":
            assert docs.columns == columns and docs.schema["n_chars"].dataType == before.schema["n_chars"].dataType
            assert docs.where("n_chars <> length(text)").isEmpty()
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] == counts[4]
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in by["line_dedup"])
    want = {(d, t) for d, t, _, dropped in slow_dedup(before) if not dropped or (t or "").split()}
    assert set(after) == want
    before, after = ([(r["doc_id"], r["text"]) for r in x.collect()] for x in by["near_duplicates"])
    assert sorted(after) == sorted((d, t) for d, t in before if (d, d) in {(d, c) for d, _, c in slow_groups(before, 5, 80)})
    before, after = by["mixture"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = defaultdict(int)
    for r in after.collect():
        taken[r["source"]] += size(r["text"])
    plan = mixing.mix(before.withColumn("size", mixing.word_count(before["text"]))).groupBy("source").agg({"taken": "sum"}).collect()
    assert {k: v for k, v in taken.items() if v} == {r[0]: r[1] for r in plan if r[1]}
    rerun = corpus_pipeline.run(spark, small)
    assert sorted(map(repr, rerun.collect())) == sorted(map(repr, docs.collect()))


def test_stages_keep_the_callers_columns(spark, small):
    text = lambda i: " ".join(f"word{i}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(80))
    names = ["target", "taken", "source_size", "n_lines", "n_dropped", "size", "word", "line", "root", "key", "kept", "n_words", "ids", "c0"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, text(i), "en", "ab"[i % 2], len(text(i)), *["mine"] * len(names)) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared_table(stage(spark, docs, small), "test", spark)
        assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        assert {tuple(r[n] for n in names) for r in docs.collect()} == {("mine",) * len(names)}, name
    assert docs.count() >= 12
    assert {r["n_tokens"] for r in corpus_pipeline.encoded(spark, docs, small).collect()} != {0}


def test_hot_keys_are_dealt(spark):
    rows = [(None, "s", i % 50, i) for i in range(2000)] + [(7, "s", i % 40, i) for i in range(2000)] + [(i, "s", 3, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, n int")
    got = mixing.mix(docs, prefix="x_").collect()
    assert len(got) == len(rows) and abs(sum(r["x_taken"] for r in got) - got[0]["x_target"]) <= 1
    again = mixing.mix(docs.repartition(3), prefix="x_").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    keyed = docs.withColumn("tie", F.xxhash64("n"))
    bounds = range_bounds(keyed, "doc_id", 20)
    sizes = keyed.withColumn("r", range_of("doc_id", bounds, "tie")).groupBy("r").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max(F.col("doc_id").isNull()).alias("z")).orderBy("r").collect()
    assert max(r["n"] for r in sizes) < 600
    known = [(r["a"], r["b"]) for r in sizes if r["a"] is not None]
    assert all(x[1] <= y[0] for x, y in zip(known, known[1:], strict=False))
    last_null = max(r["r"] for r in sizes if r["z"])
    assert all(r["a"] is None for r in sizes if r["r"] < last_null)


def test_pipeline_of_odd_tables(spark, small):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "w " * 60, "en", None, 120), (1, "w " * 60, "en", None, 120), (2, "", None, "s", 0)], table(spark, small, "documents").schema)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = shared_table(stage(spark, rows, small), "test", spark)
            assert name == "encoded" or out.columns == rows.columns
            if name != "encoded":
                shared_table(corpus_pipeline.STAGES[-1][1](spark, out, small), "test", spark)


def test_forest_needs_no_order():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(40)]
    nodes = rng.permutation(10_000)[:40].astype(np.int64) - 5000
    u, v = jaccard.forest(nodes, sets, np.zeros(40, int))
    part = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                part = [part[j] if x == part[i] else x for x in part]
    least = {p: min(int(nodes[i]) for i in range(40) if part[i] == p) for p in part}
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {int(nodes[i]): least[part[i]] for i in range(40) if least[part[i]] != nodes[i]}
