"""A purge by footers leaves what a purge of rows leaves, and reads only the files it must."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelflife.operators import footers
from shelflife.operators.purge import purge_table
from shelflife.operators.retention import retained_rows

AS_OF = dt.datetime(2025, 6, 15, 12)


def table(spark, kind="timestamp", rows=400):
    """Rows an hour apart, some without a time."""
    at = F.lit("2025-06-15 12:00:00").cast(kind) - F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
    return spark.range(rows).select("id", F.when(F.col("id") % 97 != 5, at).alias("at"), (F.col("id") % 2).cast("string").alias("part"))


def ids(spark, path):
    return sorted(r["id"] for r in spark.read.option("mergeSchema", "true").parquet(path).select("id").collect())


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_equal_to_the_purge_of_rows(spark, tmp_path, kind):
    df = table(spark, kind).repartitionByRange(8, "id").sortWithinPartitions("id")
    for name in "ab":
        df.write.partitionBy("part").parquet(str(tmp_path / name))
    found = {r["action"]: tuple(r)[1:] for r in footers.purge_by_footers(spark, str(tmp_path / "a"), AS_OF, 120, "at").collect()}
    purge_table(spark, str(tmp_path / "b"), "part", AS_OF, 120, "at")
    assert ids(spark, str(tmp_path / "a")) == ids(spark, str(tmp_path / "b"))
    assert ids(spark, str(tmp_path / "a")) == sorted(r["id"] for r in retained_rows(df, AS_OF, 120, "at").collect())
    assert sum(files for files, _, _ in found.values()) == 16 and found["drop"][2] == 0 and found["keep"][1] == found["keep"][2]
    # Old files hold either no row without a time and are dropped unread, or some and are read.
    assert found["drop"][0] >= 6 and found["rewrite"][0] <= 6
    assert sorted(os.listdir(tmp_path / "a")) == ["_SUCCESS", "part=0", "part=1"] or "._SUCCESS.crc" in os.listdir(tmp_path / "a")
    assert footers.purge_by_footers(spark, str(tmp_path / "a"), AS_OF, 120, "at").where("action <> 'keep'").count() == 0


def test_only_files_on_both_sides_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(10):
        table(spark).where(f"at is not null and id div 40 = {k}").coalesce(1).write.mode("append").parquet(path)
    actions = footers.file_actions(footers.file_ranges(spark, path, "at"), AS_OF, 120).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in actions} == {"keep": 3, "drop": 6, "rewrite": 1}
    kept = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}
    footers.purge_by_footers(spark, path, AS_OF, 120, "at")
    after = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}
    assert len(after) == 4 and len(after.items() & kept.items()) == 3


def test_footers_that_do_not_tell(spark, tmp_path):
    path = str(tmp_path / "t")
    df = table(spark, rows=50)
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        df.coalesce(1).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    spark.range(1000, 1003).coalesce(1).write.mode("append").parquet(path)  # without the column
    df.selectExpr("id + 2000 AS id", "at", "part", "'x' AS more").where("id % 97 = 5").coalesce(1).write.mode("append").parquet(path)
    known = {r["rows"]: (r["known"], r["low"]) for r in footers.file_ranges(spark, path, "at").collect()}
    assert known[50] == (False, None) and known[3] == (True, None)
    footers.purge_by_footers(spark, path, AS_OF, 24, "at")
    wanted = [i for i in range(50) if i <= 24 or i % 97 == 5] + [1000, 1001, 1002]
    assert [i for i in ids(spark, path) if i < 2000] == wanted


def test_a_purge_killed_midway_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = table(spark).repartitionByRange(8, "id").sortWithinPartitions("id")
    df.write.partitionBy("part").parquet(path)
    staged = {}

    def killed(spark, staging):
        manifest = spark.read.parquet(f"{staging}/manifest").where("action <> 'keep'").toPandas().sort_values("action")
        half = manifest.iloc[len(manifest) // 3 : -1]
        list(footers._exchange(staging)(iter([half])))
        os.rename(*(lambda uri, mark: (footers.mounted_path(uri), f"{staging}/old/{mark}"))(*manifest.iloc[-1][["file", "mark"]]))
        staged["left"] = len(manifest) - len(half)
        raise RuntimeError("killed")

    monkeypatch.setattr(footers, "_finish", killed)
    with pytest.raises(RuntimeError, match="killed"):
        footers.purge_by_footers(spark, path, AS_OF, 120, "at")
    monkeypatch.undo()
    assert staged["left"] > 1
    footers.purge_by_footers(spark, path, AS_OF, 100_000, "at")
    assert ids(spark, path) == sorted(r["id"] for r in retained_rows(df, AS_OF, 120, "at").collect())
    assert not os.path.exists(f"{path}/{footers.STAGING}")
