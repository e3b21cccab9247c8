"""Versions, clones, evolution, expectations and streaming."""

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import layout, quality
from tidemark.sources.paths import workspace
from tidemark.sources.schemas import EVENT
from tidemark.sources.store import CommitConflict, Table
from tidemark.streaming.ingest import ingest, ingest_parquet, land, parsed


@pytest.fixture
def table(spark):
    t = Table(spark, workspace(spark, "test"), "gold")
    t.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"), ("id",))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_never_change(table, spark):
    before = rows(table.read(0))
    table.append(spark.createDataFrame([(4, "d")], "id long, name string"))
    table.update(F.col("id") == 1, {"name": F.lit("z")})
    table.delete(F.col("name") == "b")
    assert rows(table.read(0)) == before
    assert rows(table.read()) == [(1, "z"), (3, None), (4, "d")]
    table.restore(0)
    assert rows(table.read()) == before
    assert [r.operation for r in table.history().orderBy("version").collect()] == ["CREATE", "APPEND", "UPDATE", "DELETE", "RESTORE"]


def test_clone_is_independent_and_kept(table):
    copy = table.clone(workspace(table.spark, "copy"), 0)
    table.delete(F.lit(True))
    assert copy.read().count() == 3
    table.clone(copy.path)
    assert copy.versions() == [0]
    assert copy.entry().properties["cloned_version"] == "0"
    assert copy.violations() == []


def test_evolution_rewrites_nothing(table):
    files = table.entry().files
    table.add_column("extra", "double", after="id")
    table.rename_column("name", "label")
    table.set_cluster_by("label")
    assert table.entry().files == files
    assert table.read().columns == ["id", "extra", "label"]
    assert rows(table.read()) == [(1, None, "a"), (2, None, "b"), (3, None, None)]
    assert table.read(0).columns == ["id", "name"]
    table.rename_column("label", "name")
    assert rows(table.read().select("name")) == [("a",), ("b",), (None,)]


def test_optimize_and_vacuum(table, spark):
    for i in range(3):
        table.append(spark.createDataFrame([(10 + i, "x")], "id long, name string"))
    want = rows(table.read())
    table.optimize(1)
    assert rows(table.read()) == want
    assert table.detail()["files"] == 1
    assert table.vacuum() == []


def test_unknown_columns_are_refused(table, spark):
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(1, 2)], "id long, other long"))


def test_one_of_two_writers_fails(table):
    entry = table._next("SET PROPERTIES")
    table._commit(entry)
    with pytest.raises(CommitConflict):
        table._commit(entry)


def test_version_at(table):
    now = time.time()
    table.delete(F.lit(True))
    assert table.version_at(now) == 0
    with pytest.raises(LookupError):
        table.version_at(0)


def test_retention(table):
    table.set_properties(log="1 week")
    assert table.violations()


def events(spark):
    return spark.createDataFrame(
        [(datetime(2024, 1, 1, 0, 7 * i), "view", "p", None, None, None, 1.0 + i, "u", None) for i in range(4)], EVENT
    )


def test_ingest_reads_each_file_once(spark):
    root = workspace(spark, "stream")
    land(events(spark), f"{root}/in", 5)
    land(events(spark), f"{root}/in", 5, mode="ignore")
    table = Table(spark, f"{root}/bronze", "bronze")
    for _ in range(2):
        ingest(spark, f"{root}/in", table, f"{root}/check")
    got = table.read()
    assert got.count() == 4
    assert {r._batch_id for r in got.collect()} == {"2024-01-01T00:00", "2024-01-01T00:05", "2024-01-01T00:10", "2024-01-01T00:20"}
    (key,) = [p for p in table.entry().properties if p.startswith("epoch of ")]
    before = table.versions()
    table.append_once(got, key.removeprefix("epoch of "), int(table.entry().properties[key]))
    assert table.versions() == before
    # A new checkpoint is another query: its epochs start at 0 again, and its batches are not taken for known ones.
    log = ingest(spark, f"{root}/in", table, f"{root}/check2")
    assert table.read().count() == 8
    assert {r.rule: r.failed for r in log.collect()}["brand_present"] == 4


def test_rescued_fields(spark, tmp_path):
    lines = [{"price": 1.5, "user_id": "u"}, {"price": "much", "user_id": "u"}, {"price": 2.0, "colour": "red"}]
    folder = tmp_path / "dt=2024-01-01" / "hh=00" / "min5=05"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join([*map(json.dumps, lines), "broken"]))
    got = parsed(spark.read.text(f"file://{folder}"))
    assert {r._rescued_data for r in got.collect()} == {None, '{"price":"much"}', '{"colour":"red"}', "broken"}
    assert {r._batch_id for r in got.collect()} == {"2024-01-01T00:05"}


def test_parquet_stream(spark):
    root = workspace(spark, "parquet")
    events(spark).write.parquet(f"{root}/in")
    for _ in range(2):
        ingest_parquet(spark, f"{root}/in", EVENT, f"{root}/out", f"{root}/check")
    assert spark.read.parquet(f"{root}/out").count() == 4


def test_expectations(spark):
    data = spark.createDataFrame([(1.0,), (0.0,), (None,)], "price double")
    rules = {"positive": ("price > 0", "drop")}
    row = quality.expectation_counts(data, "d", rules).first()
    assert (row.passed, row.failed) == (1, 2)
    assert quality.enforce(data, rules).count() == 1
    with pytest.raises(Exception, match="positive"):
        quality.enforce(data, {"positive": ("price > 0", "fail")}).collect()
    schema = EVENT.simpleString()
    empty = spark.createDataFrame([], schema).withColumns({"_rescued_data": F.lit(""), "_batch_id": F.lit("")})
    assert quality.expectation_counts(empty, "d", quality.CLICKSTREAM).count() == 10


def test_digest_and_plans(spark):
    data = spark.range(100).withColumn("x", F.lit("a"))
    assert layout.digest(data).first() == layout.digest(data.orderBy(F.desc("id"))).first()
    plan = layout.physical_plan(data.join(F.broadcast(spark.range(3)), "id"))
    assert layout.plan_operators(plan) == ["BroadcastHashJoin"]
    assert layout.timed(data) > 0
    hot = spark.range(2000).select(F.when(F.col("id") < 1900, 0).otherwise(F.col("id")).alias("k"))
    assert layout.partition_skew(hot, "k", 50).first().ratio > 10


def test_parameterised_table_name(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert spark.sql("SELECT count(*) AS n FROM IDENTIFIER(:t)", args={"t": "three"}).first().n == 3
