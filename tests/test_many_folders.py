"""Writers and inventories of many small folders: by tasks, whole, and in Spark's layout."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worktrail.sources import files, sinks
from worktrail_queries import gold as G
from worktrail_queries import sources_q as W

ODD = ["plain", "a b", "x/y", "50%", "k=v", "[1]", "{z}", "q?", "it's", 'say "so"', "é", "c:d#e*f^g\\h", "", None]


@pytest.fixture
def event_folder(spark, tmp_path):
    kinds = ["click", "view", "purchase", "error", "signup"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i // 5 % 4, kinds[i % 5], 1.0, json.dumps({"k": i % 15})) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_folders_are_named_as_spark_names_them(spark, tmp_path):
    rows = [(v, i, f"t{i}") for i, v in enumerate(ODD)] + [("plain", 99, "more"), (None, 98, None)]
    df = spark.createDataFrame(rows, "p string, n long, t string")
    df.write.partitionBy("p", "n").parquet(f"{tmp_path}/spark")
    sinks.write_folders(df, f"{tmp_path}/tasks", ["p", "n"])
    below = lambda at: sorted(os.path.relpath(d, at) for d, _, names in os.walk(at) if any(x.endswith(".parquet") for x in names))
    assert below(f"{tmp_path}/tasks") == below(f"{tmp_path}/spark")
    read = lambda at: sorted(map(str, spark.read.schema(df.schema).parquet(at).collect()))
    assert read(f"{tmp_path}/tasks") == read(f"{tmp_path}/spark")


def test_tables_are_read_back_whole_with_a_manifest_by_project(spark, tmp_path):
    rows = [(f"p{i % 7}" if i % 50 else None, i, [f"v{i}"], {"k": str(i)}, datetime(2024, 1, 1) + timedelta(seconds=i)) for i in range(500)]
    df = spark.createDataFrame(rows, "project_id string, n long, items array<string>, open map<string,string>, ts timestamp")
    told = sinks.write_tables({"many": df, "none": df.filter("n < 0"), "plain": df.drop("project_id")}, str(tmp_path))
    assert {r.table: r.rows for r in told.collect()} == {"many": 500, "none": 0, "plain": 500}
    want = {("many", r.project_id): r.n for r in df.groupBy("project_id").agg(F.count("*").alias("n")).collect()}
    assert {(r.table, r.project_id): r.rows for r in spark.read.parquet(f"{tmp_path}/manifest").collect()} == want
    back = spark.read.schema(df.schema).parquet(f"{tmp_path}/many").select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    # What is returned lists no folder of the partition.
    assert not any("/many/" in uri for uri in told.inputFiles())
    assert {r.table: r.rows for r in sinks.write_tables({"many": df.limit(3)}, str(tmp_path)).collect()} == {"many": 3}
    assert spark.read.schema(df.schema).parquet(f"{tmp_path}/many").count() == 3


def test_a_damaged_file_is_no_row_of_the_manifest(spark, tmp_path):
    df = spark.createDataFrame([("p", "x" * 5000)], "project_id string, t string")
    file = sinks.write_folders(df, f"{tmp_path}/t", ["project_id"]).first()
    at = file.path.removeprefix("file:")
    data = bytearray(open(at, "rb").read())
    data[4:40] = b"\0" * 36
    open(at, "wb").write(bytes(data))
    read = spark.createDataFrame([("t", "p", file.path)], "table string, project_id string, path string").mapInArrow(sinks._read_whole, "table string, project_id string, rows long")
    with pytest.raises(Exception):  # noqa: B017
        read.collect()


def test_small_tables_have_many_writers_and_large_folders_many_files(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('p', id % 40) as project_id", "id as n")
    written = sinks.write_folders(df, f"{tmp_path}/small", ["project_id"])
    assert len({os.path.basename(r.path) for r in written.collect()}) > 4 and written.count() == 40
    large = spark.range(3000).selectExpr("if(id % 10 = 0, concat('p', id % 40), null) as project_id", "id as n")
    parts = sinks.write_folders(large, f"{tmp_path}/large", ["project_id"], file_rows=100)
    assert parts.filter("project_id is null").count() > 5 and parts.agg(F.sum("rows")).first()[0] == 3000
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/large").collect()) == list(range(3000))


def test_project_has_its_graph_and_profile(spark, event_folder, monkeypatch):
    at = []
    monkeypatch.setattr(W, "scratch_path", lambda s, name: at.append(f"{event_folder}/{name}") or at[0])
    counts = {r.table: r.rows for r in W.write_project(spark, event_folder).collect()}
    g = G.gold(spark, event_folder)
    assert counts == {n: getattr(g, n).count() for n in ("artifacts", "events", "memories", "probes", "memory_events")} | {"projects": g.probes.select("project_id").distinct().count()}
    assert min(counts.values()) > 0
    back = spark.read.schema(g.memory_events.schema).parquet(f"{at[0]}/memory_events").select(*g.memory_events.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, g.memory_events.collect()))


def test_tasks_list_the_files(spark, tmp_path, monkeypatch):
    for name in ("a/b/c/x.txt", "a/y.csv", "a/z.json", "_skip/x.txt", ".skip/x.txt", "_k=v/x.txt", "a/_x.txt", "a/.x.txt", "a/empty.txt", "a b/50%.txt", "top.txt", "a/u._COPYING_"):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        open(f"{tmp_path}/{name}", "w").write("" if "empty" in name else name)
    seen = {p: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", p).load(str(tmp_path)).select("path").collect()) for p in ("*", "*.txt", "*.{csv,json}", "[xy].*", "[^x]*", "?.txt")}

    def refused(self):
        raise AssertionError("files listed by the driver")

    monkeypatch.setattr(DataFrame, "inputFiles", refused)
    for pattern, names in seen.items():
        rows = files.file_inventory(spark, str(tmp_path), pattern).collect()
        got = sorted(r.name for r in rows)
        assert [n for n in got if n != "a/empty.txt"] == names, pattern
        assert ("a/empty.txt" in got) == (pattern in ("*", "*.txt", "[^x]*"))
        assert all(r.bytes == os.path.getsize(f"{tmp_path}/{r.name}") and r.path == f"file:{tmp_path}/{r.name}" for r in rows)
