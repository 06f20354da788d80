from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from shelflife.plans.clean import clean_trees, plan_run
from shelflife.sources.tables import table_inventory
from shelflife.sources.tree import roots_below
from shelflife.streaming.session_end import LOCAL_MERGE, closed_sessions, run_on_session_end
from trees import put

SCHEMA = "user string, at {}"


def minutes(*values):
    return [dt.datetime(2025, 6, 15) + dt.timedelta(minutes=m) for m in values]


def write(spark, folder, rows, kind="timestamp_ntz"):
    spark.createDataFrame(rows, SCHEMA.format(kind)).coalesce(1).write.mode("append").parquet(str(folder))


def start(spark, tmp_path, retention_pass, policy=None, kind="timestamp_ntz"):
    activity = spark.readStream.schema(SCHEMA.format(kind)).parquet(str(tmp_path / "in"))
    sessions = closed_sessions(activity, "user", "at", "10 minutes", "5 minutes")
    query = run_on_session_end(sessions, retention_pass, str(tmp_path / "out"), policy)
    query.awaitTermination()
    return query


def table_pass(spark, tmp_path):
    def run(as_of, run_dir):
        table = spark.read.schema(SCHEMA.format("timestamp_ntz")).parquet(str(tmp_path / "in"))
        entries = table_inventory(table, "user", "user", F.lit(1), "at")
        return plan_run(entries, as_of, 1, False).total

    return run


@pytest.fixture
def activity(spark, tmp_path):
    rows = [("a", t) for t in minutes(0, 5, 9, 40, 41)] + [("b", t) for t in minutes(3, 200)]
    write(spark, tmp_path / "in", rows)


def test_sessions_close_behind_the_watermark(spark, tmp_path, activity):
    seen = []

    def retention_pass(as_of, run_dir):
        seen.append(as_of)
        return table_pass(spark, tmp_path)(as_of, run_dir)

    start(spark, tmp_path, retention_pass)
    rows = spark.read.parquet(str(tmp_path / "out" / "sessions")).collect()
    found = sorted((r["user"], r["session_end"].hour * 60 + r["session_end"].minute, r["events"]) for r in rows)
    assert found == [("a", 19, 3), ("a", 51, 2), ("b", 13, 1)]
    assert seen == [dt.datetime(2025, 6, 15, 0, 51, tzinfo=dt.timezone.utc)]
    run = spark.read.parquet(str(tmp_path / "out" / "runs")).first()
    assert run["closed_sessions"] == 3
    assert run["session_message"] == "[retention] No old files found"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_a_pause_of_exactly_the_gap(spark, tmp_path, kind):
    rows = [("a", t) for t in minutes(0, 10)] + [("b", t) for t in minutes(0, 11)] + [("c", t) for t in minutes(900)]
    if kind == "timestamp":
        rows = [(user, at.replace(tzinfo=dt.timezone.utc)) for user, at in rows]
    write(spark, tmp_path / "in", rows, kind)
    out = str(tmp_path / "out")
    activity = spark.readStream.schema(SCHEMA.format(kind)).parquet(str(tmp_path / "in"))
    sessions = closed_sessions(activity, "user", "at", "10 minutes", "5 minutes")
    run_on_session_end(sessions, None, out, {"clean_on_session_end": False}).awaitTermination()
    found = spark.read.parquet(f"{out}/sessions").collect()
    assert sorted((r["user"], r["events"]) for r in found) == [("a", 2), ("b", 1), ("b", 1)]


def test_more_activity_goes_on_from_the_checkpoint(spark, tmp_path, activity):
    start(spark, tmp_path, table_pass(spark, tmp_path))
    write(spark, tmp_path / "in", [("b", t) for t in minutes(205, 400)])
    start(spark, tmp_path, table_pass(spark, tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out" / "sessions")).collect()
    assert sorted((r["user"], r["events"]) for r in rows) == [("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 2


def test_files_one_at_a_time_give_the_same_sessions(spark, tmp_path):
    rows = [("a", t) for t in minutes(0, 5, 30, 31, 36, 100)] + [("b", t) for t in minutes(2, 11, 33, 90)]
    ends = [12, 34, 1000]
    for start_at, end in zip([0, *ends], ends):
        part = [r for r in rows if start_at <= (r[1] - dt.datetime(2025, 6, 15)).seconds / 60 < end]
        write(spark, tmp_path / "in", part)
        time.sleep(1.1)
    found = {}
    for name, files in {"all": 1000, "each": 1}.items():
        reader = spark.readStream.schema(SCHEMA.format("timestamp_ntz")).option("maxFilesPerTrigger", files)
        sessions = closed_sessions(reader.parquet(str(tmp_path / "in")), "user", "at", "10 minutes", "5 minutes")
        out = str(tmp_path / name)
        run_on_session_end(sessions, table_pass(spark, tmp_path), out).awaitTermination()
        closed = spark.read.parquet(f"{out}/sessions").select("user", "session_start", "session_end", "events")
        found[name] = sorted(map(str, closed.collect()))
    assert found["all"] == found["each"] and len(found["all"]) == 4
    assert spark.read.parquet(str(tmp_path / "all" / "runs")).count() == 1
    assert spark.read.parquet(str(tmp_path / "each" / "runs")).count() > 1


def test_a_failed_batch_is_repeated_without_a_trace(spark, tmp_path, activity):
    def fails(as_of, run_dir):
        raise RuntimeError("driver lost")

    with pytest.raises(Exception, match="driver lost"):
        start(spark, tmp_path, fails)
    start(spark, tmp_path, table_pass(spark, tmp_path))
    assert spark.read.parquet(str(tmp_path / "out" / "sessions")).count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 1


def test_disabled(spark, tmp_path, activity):
    def never(as_of, run_dir):
        raise AssertionError("the pass must not run")

    start(spark, tmp_path, never, {"clean_on_session_end": False})
    assert spark.read.parquet(str(tmp_path / "out" / "sessions")).count() == 3
    assert not (tmp_path / "out" / "runs").exists()


def test_without_summary(spark, tmp_path, activity):
    start(spark, tmp_path, table_pass(spark, tmp_path), {"session_end_summary": False})
    run = spark.read.parquet(str(tmp_path / "out" / "runs")).first()
    assert run["session_message"] is None and run["message"] is not None


def test_sessions_merge_before_the_shuffle(spark, tmp_path, activity):
    before = spark.conf.get(LOCAL_MERGE, "false")
    query = start(spark, tmp_path, table_pass(spark, tmp_path))
    plan = query._jsq.explainInternal(False)
    below = plan[plan.index("Exchange") :]
    assert "MergingSessions" in below
    assert spark.conf.get(LOCAL_MERGE, "false") == before


def test_session_zone_does_not_matter(spark, tmp_path, activity):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start(spark, tmp_path, table_pass(spark, tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    run = spark.read.parquet(str(tmp_path / "out" / "runs")).first()
    assert run["as_of"].replace(tzinfo=None) == dt.datetime(2025, 6, 15, 0, 51)


def test_a_closed_session_cleans_trees(spark, tmp_path, activity, base):
    old = put(base / "debug" / "old", "x")
    os.utime(old, (1_600_000_000, 1_600_000_000))

    def retention_pass(as_of, run_dir):
        return clean_trees(spark, roots_below(str(base)), as_of, run_dir=run_dir).total

    start(spark, tmp_path, retention_pass)
    assert not old.exists()
    run = spark.read.parquet(str(tmp_path / "out" / "runs")).first()
    assert run["session_message"] == "[retention] Cleaned 1 files (1 B freed)"


def test_policy_is_read_at_every_batch(spark, tmp_path, activity):
    """NULL means not set; switching cleaning off takes effect at the next batch, which leaves a record."""
    policies = [{"clean_on_session_end": None}, {"clean_on_session_end": False}]
    start(spark, tmp_path, table_pass(spark, tmp_path), lambda: policies[0])
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 1
    policies.pop(0)
    write(spark, tmp_path / "in", [("b", t) for t in minutes(205, 400)])
    start(spark, tmp_path, table_pass(spark, tmp_path), lambda: policies[0])
    assert spark.read.parquet(str(tmp_path / "out" / "runs")).count() == 1
    skipped = spark.read.parquet(str(tmp_path / "out" / "skipped")).first()
    assert skipped["closed_sessions"] == 1 and skipped["as_of"] is not None


def test_batches_without_closed_sessions_leave_nothing(spark, tmp_path, activity):
    start(spark, tmp_path, table_pass(spark, tmp_path))
    folders = set(os.listdir(tmp_path / "out" / "sessions"))
    write(spark, tmp_path / "in", [("z", t) for t in minutes(206)])
    start(spark, tmp_path, table_pass(spark, tmp_path))
    kept = {f for f in os.listdir(tmp_path / "out" / "sessions") if f.startswith("batch_id=")}
    assert all(any(n.endswith(".parquet") for n in os.listdir(tmp_path / "out" / "sessions" / f)) for f in kept)
    assert folders <= set(os.listdir(tmp_path / "out" / "sessions"))
