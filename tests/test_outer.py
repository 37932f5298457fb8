"""Sources, sinks, the command line, streaming, and the driver's entry."""

from __future__ import annotations

import struct

import duckdb
import pytest

from textindex import cli
from textindex.operators import local
from textindex.plans import queries as Q
from textindex.plans.metrics import Stages
from textindex.plans.store import shared_dir
from textindex.sources.corpus import from_files
from textindex.sources.sinks import write_neighbour_files
from textindex.streaming.incremental import index_stream


@pytest.fixture
def folder(tmp_path):
    for name, data in (("b.bin", b"BANANA"), ("a.bin", b"\0\0\xff"), ("c.bin", b"")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_files(spark, folder):
    rows = {r["doc_id"]: bytes(r["bytes"]) for r in from_files(spark, f"{folder}/in").collect()}
    assert rows == {0: b"\0\0\xff", 1: b"BANANA"}


def test_command_line(spark, folder):
    assert cli.lz77(spark, f"{folder}/in", f"{folder}/out") == 4 + 3  # phrases
    assert (folder / "out" / "1_lz77.bin").read_bytes() == b"".join(struct.pack("<QQ", *f) for f in ((66, 0), (65, 0), (78, 0), (1, 3)))
    same, clock = cli.profile(spark, f"{folder}/in")
    assert same and set(clock.seconds) == {"in tasks", "distributed", "compare"}
    assert cli.main([]) == 2


def test_neighbour_files(spark, folder):
    corpus = from_files(spark, f"{folder}/in")
    rows = write_neighbour_files(corpus, f"{folder}/values", "x").collect()
    assert sorted((r["doc_id"], r["file"], r["n_bytes"]) for r in rows) == [(0, "x0_nsv.bin", 12), (0, "x0_psv.bin", 12), (1, "x1_nsv.bin", 24), (1, "x1_psv.bin", 24)]
    none = 2**32 - 1
    assert struct.unpack("<6I", (folder / "values" / "x1_psv.bin").read_bytes()) == (none, none, 0, none, 0, none)
    assert struct.unpack("<6I", (folder / "values" / "x1_nsv.bin").read_bytes()) == (none, 0, none, 1, 2, 3)


def test_files_are_numbered_by_path(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"f{i:02d}.bin").write_bytes(b"%d" % i)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in from_files(spark, str(tmp_path)).collect()} == {i: b"%d" % i for i in range(30)}


def test_a_cluster_needs_a_shared_folder():
    session = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": type("X", (), {"master": "yarn"})})
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session, "x")


def test_stages(spark):
    clock = Stages()
    with clock.stage("a"):
        pass
    assert clock.table(spark).count() == 1 and clock.peak_mb > 0
    assert "driver" in {r["executor"] for r in clock.executors(spark).collect()}


def test_stream_indexes_each_text_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} text") for i in range(10)], "doc_id bigint, text string")
    docs.where("doc_id < 6").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        index_stream(stream, "doc_id", "text", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        docs.where("doc_id >= 6").write.mode("append").parquet(f"{tmp_path}/in")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = local.lz_encoded(docs.selectExpr("doc_id", "encode(text, 'UTF-8') AS bytes"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_queries_equal_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("part", "benchmark", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = Q.QUERIES[name](spark, small)
    want = con.sql(Q.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(r) for r in want.select(*columns).fetchall()), key=repr)
    assert a == b


def test_rank_changes_needs_no_join(spark, small):
    plan = Q.rank_changes(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
