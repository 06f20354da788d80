from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelflife.operators import retention, stats
from shelflife.operators.prune import children_first, prune_plan, prune_plan_at
from shelflife.sources.tree import INVENTORY_SCHEMA

UTC = dt.timezone.utc
AS_OF = dt.datetime(2025, 6, 15, 12, tzinfo=UTC)


def hours_ago(hours, micros=0):
    return AS_OF - dt.timedelta(hours=hours) - dt.timedelta(microseconds=micros)


def inventory(spark, rows):
    full = [(d, p, s, t, is_dir, t is not None) for d, p, s, t, is_dir in rows]
    return spark.createDataFrame(full, INVENTORY_SCHEMA)


@pytest.fixture
def entries(spark):
    return inventory(
        spark,
        [
            ("a", "a/old", 10, hours_ago(48), False),
            ("a", "a/edge", 20, hours_ago(24), False),
            ("a", "a/just", 30, hours_ago(24, 1), False),
            ("a", "a/new", 40, hours_ago(0), False),
            ("a", "a/unknown", None, None, False),
            ("a", "a/sub", None, hours_ago(99), True),
            ("b", "b/future", 5, hours_ago(-1), False),
        ],
    )


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_strictly_older_than_the_cutoff(entries):
    assert paths(retention.expired_files(entries, AS_OF, 24)) == ["a/just", "a/old"]


def test_negative_window_expires_all_with_a_known_time(entries):
    found = paths(retention.expired_files(entries, AS_OF, -2))
    assert found == ["a/edge", "a/just", "a/new", "a/old", "b/future"]


def test_naive_as_of_is_utc(entries):
    assert paths(retention.expired_files(entries, AS_OF.replace(tzinfo=None), 24)) == ["a/just", "a/old"]


def test_retained_is_the_exact_complement(entries):
    kept = paths(retention.retained_rows(entries, AS_OF, 24))
    gone = paths(entries.where(retention.expired_flag(entries, AS_OF, 24)))
    assert sorted(kept + gone) == paths(entries)
    assert "a/unknown" in kept


def test_windows_of_their_own(spark, entries):
    policy = spark.createDataFrame([("b", -2), ("c", 1)], "dir_name string, retention_hours int")
    assert paths(retention.expired_by_policy(entries, policy, AS_OF)) == ["a/just", "a/old", "b/future"]
    policy = spark.createDataFrame([("a", 30), ("b", None)], "dir_name string, retention_hours int")
    assert paths(retention.expired_by_policy(entries, policy, AS_OF)) == ["a/old"]
    assert paths(retention.expired_by_policy(entries, policy.limit(0), AS_OF)) == ["a/just", "a/old"]


def test_stats(spark, entries):
    roots = spark.createDataFrame([("a",), ("b",), ("none",)], "dir_name string")
    found = stats.stats_for_roots(roots, stats.dir_stats(entries, AS_OF, 24))
    rows = {r["dir_name"]: tuple(r)[1:] for r in found.collect()}
    assert rows == {"a": (5, 100, 2, 48.0), "b": (1, 5, 0, -1.0), "none": (0, 0, 0, None)}
    lines = {r["dir_name"]: r["line"] for r in stats.status_report(found).collect()}
    assert lines["a"] == "  a: 100 B (5 files) ⚠️  2 violations"
    assert lines["none"] == "  none: 0 B (0 files)"
    total = stats.status_summary(found, 24).first()
    assert (total["file_count"], total["violations"], total["max_age_hours"]) == (6, 2, 48.0)
    assert total["oldest"] == "Oldest file: 48.0 hours ago"
    assert total["verdict"] == "⚠️  Retention violations: 2 files exceed 24h"


def test_nothing_at_all(spark, entries):
    none = entries.limit(0)
    total = stats.status_summary(stats.dir_stats(none, AS_OF, 24), 24).first()
    assert (total["file_count"], total["total_size"], total["violations"]) == (0, 0, 0)
    assert total["max_age_hours"] is None and total["oldest"] is None
    assert total["verdict"] == "✓ No retention violations"
    summary = stats.purge_summary(retention.purge_plan(none, AS_OF, 24), False)
    row = stats.purge_total(summary, 24, False).first()
    assert (row["files"], row["bytes"]) == (0, 0)
    assert row["message"] == "No files older than 24h found"
    assert row["session_message"] == "[retention] No old files found"


def test_plan_counts_an_unknown_size_as_zero(spark):
    entries = inventory(spark, [("a", "a/x", None, hours_ago(48), False), ("a", "a/y", 2048, hours_ago(48), False)])
    plan = retention.purge_plan(entries, AS_OF, 24, True)
    assert {r["path"]: r["message"] for r in plan.collect()} == {
        "a/x": "[DRY RUN] Would delete: a/x (0 B)",
        "a/y": "[DRY RUN] Would delete: a/y (2.0 KB)",
    }
    assert stats.purge_summary(plan, True).first()["message"] == "[DRY RUN] a: Would delete 2 files (2.0 KB)"
    assert retention.purge_plan(entries, AS_OF, 24).first()["message"] is None


def test_predicates_reach_the_reader(spark, tmp_path):
    table = (
        spark.range(1000)
        .select(
            F.lit("a").alias("dir_name"),
            F.col("id").cast("string").alias("path"),
            F.col("id").alias("size_bytes"),
            F.timestamp_micros(F.unix_micros(F.lit(AS_OF)) - F.col("id") * 3_600_000_000).alias("mtime"),
            F.lit(False).alias("is_dir"),
            F.lit(True).alias("stat_ok"),
        )
        .withColumn("day", F.to_date("mtime"))
    )
    table.write.partitionBy("day").parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    gone = retention.expired_files(read, AS_OF, 48, partition_date="day")
    assert gone.count() == 1000 - 49
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(mtime" in plan
    assert "(day" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "size_bytes" not in gone.select("path")._jdf.queryExecution().executedPlan().toString()
    kept = retention.retained_rows(read, AS_OF, 48)._jdf.queryExecution().executedPlan().toString()
    assert "Or(IsNull(mtime),GreaterThanOrEqual(mtime" in kept


def scanned_rows(df):
    """Rows the parquet scans of an executed plan handed on."""

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if "Scan parquet" in name:
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        return sum(visit(children.apply(i)) for i in range(children.size()))

    df.collect()
    return visit(df._jdf.queryExecution().executedPlan())


def test_row_groups_newer_than_the_cutoff_are_skipped(spark, tmp_path):
    path = str(tmp_path / "t")
    age = (100_000 - F.col("id")) * 1_000_000
    spark.range(100_000).coalesce(1).select(
        F.lit("a").alias("dir_name"),
        F.col("id").cast("string").alias("path"),
        F.col("id").alias("size_bytes"),
        F.timestamp_micros(F.unix_micros(F.lit(AS_OF)) - age).alias("mtime"),
        F.lit(False).alias("is_dir"),
        F.lit(True).alias("stat_ok"),
    ).write.option("parquet.block.row.count.limit", "10000").parquet(path)
    table = spark.read.parquet(path)
    gone = retention.expired_files(table, AS_OF, 24)
    assert gone.count() == 100_000 - 86_400
    assert scanned_rows(gone) <= 20_000
    policy = spark.createDataFrame([("a", 26), ("b", 25)], "dir_name string, retention_hours int")
    gone = retention.expired_by_policy(table, policy, AS_OF)
    assert gone.count() == 100_000 - 93_600
    assert scanned_rows(gone) <= 20_000


def test_prune(spark):
    entries = inventory(
        spark,
        [
            ("r", "/b/r/x/1", 1, hours_ago(48), False),
            ("r", "/b/r/x/y/2", 1, hours_ago(48), False),
            ("r", "/b/r/k/3", 1, hours_ago(1), False),
            ("r", "/b/r/k/z/4", 1, hours_ago(48), False),
            ("r", "/b/r/top", 1, hours_ago(48), False),
            ("r", "/b/r/u/5", None, None, False),
            ("r", "/b/r/x", None, hours_ago(48), True),
            ("r", "/b/r/x/y", None, hours_ago(48), True),
            ("r", "/b/r/empty", None, hours_ago(1), True),
            ("r", "/b/r/empty/inner", None, hours_ago(1), True),
            ("quiet", "/b/quiet/empty", None, hours_ago(48), True),
            ("quiet", "/b/quiet/new/6", 1, hours_ago(1), False),
        ],
    )
    plan = prune_plan_at(entries, AS_OF, 24, F.concat(F.lit("/b/"), F.col("dir_name")))
    found = {r["path"]: r["depth"] for r in plan.collect()}
    assert found == {
        "/b/r/x": 1,
        "/b/r/x/y": 2,
        "/b/r/k/z": 2,
        "/b/r/empty": 1,
        "/b/r/empty/inner": 2,
    }
    order = [r["path"] for r in children_first(plan).collect()]
    for path in order:
        assert not any(later.startswith(path + "/") for later in order[order.index(path) + 1 :])


def test_prune_of_a_swept_root_without_any_deletion(spark):
    entries = inventory(spark, [("r", "r/x/1", 1, hours_ago(48), False), ("r", "r/e", None, hours_ago(1), True)])
    none = prune_plan(entries, F.lit(False), F.col("dir_name"))
    assert none.count() == 0
    tried = prune_plan(entries, F.lit(False), F.col("dir_name"), expired=F.lit(True))
    assert paths(tried) == ["r/e"]


def test_the_curve_tells_what_any_window_frees(spark):

    rng = random.Random(8)
    now = dt.datetime(2025, 6, 15, 12)
    ages = [0, 1, 24, 24.0001, 48, 48, 71.5, 500, -3, None] + [rng.uniform(0, 100) for _ in range(100)]
    rows = [(f"r{k % 2}", f"p{k}", k if k % 7 else None, None if a is None else now - dt.timedelta(hours=a), False) for k, a in enumerate(ages)]
    df = spark.createDataFrame(rows, "dir_name string, path string, size_bytes bigint, mtime timestamp_ntz, is_dir boolean")
    for step in (1, 24):
        curve = stats.retention_curve(df, now, step).collect()
        for window in range(0, 600, step):
            for root in ("r0", "r1"):
                gone = [r for r in rows if r[0] == root and r[3] is not None and r[3] < now - dt.timedelta(hours=window)]
                later = [c for c in curve if c["dir_name"] == root and c["hours"] >= window]
                found = min(later, key=lambda c: c["hours"], default=None)
                wanted = (len(gone), sum(r[2] or 0 for r in gone))
                assert ((found["files"], found["bytes"]) if found else (0, 0)) == wanted
