"""Policies of nested folders and of periods of time against plain Python."""

from __future__ import annotations

import datetime as dt
import random

from shelflife.operators import joins, scoped

FILES = "dir_name string, path string, size_bytes bigint, mtime timestamp_ntz, is_dir boolean"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def files(spark, rows):
    return spark.createDataFrame([(d, p, 1, t, False) for d, p, t in rows], FILES)


def test_the_innermost_scope_that_says_something(spark):
    scopes = spark.createDataFrame(
        [
            ("/logs", 100, True), ("/logs/a/", 200, None), ("/logs/a/b", None, False), ("/logs/a/b", None, None),
            ("/logs/a/b/c/d", 7, None), (None, 1, None), ("/log", 5, None),
        ],
        "scope string, retention_hours int, dry_run boolean",
    )
    wanted = {
        "/logs": (100, True), "/logs/ab": (100, True), "/logs/a": (200, True), "/logs/a/x": (200, True), "/logs/a/b": (200, False),
        "/logs/a/b/c": (200, False), "/logs/a/b/c/d": (7, False), "/logs/a/b/c/d/e/f": (7, False), "/logsx": (24, False), "/log": (5, False), "": (24, False),
    }
    folders = spark.createDataFrame([(f,) for f in [*wanted, *wanted]], "folder string")
    found = scoped.folder_policies(folders, scopes).collect()
    assert {r["folder"]: (r["retention_hours"], r["dry_run"]) for r in found} == wanted
    assert len(found) == len(wanted) and all(r["clean_on_session_end"] for r in found)
    none = scoped.folder_policies(folders, scopes.limit(0), {"retention_hours": 48}).collect()
    assert {r["retention_hours"] for r in none} == {48} and len(none) == len(wanted)


def test_every_file_keeps_its_place(spark):
    rng = random.Random(4)
    rows = [("r", rng.choice(["top", "/a/x", "/a/b/x", "/a/b/c/x", "/z/x"]) + str(k), at(k)) for k in range(500)]
    scopes = spark.createDataFrame([("/a", 10), ("/a/b", 300)], "scope string, retention_hours int")
    now = at(400)
    wanted = sorted(
        p for _, p, t in rows if t < now - dt.timedelta(hours=300 if p.startswith("/a/b/") else 10 if p.startswith("/a/") else 24)
    )
    assert sorted(r["path"] for r in scoped.expired_by_folder(files(spark, rows), scopes, now).collect()) == wanted


def test_the_version_in_force(spark):
    rng = random.Random(5)
    versions = [(f"r{rng.randint(0, 5)}", at(rng.randint(0, 60) * 12), rng.choice([None, *range(1, 900, 50)])) for _ in range(80)]
    versions += [("r0", None, 3), (None, at(5), 4), ("hot", at(7 * 24), 11), ("hot", at(7 * 24), 12)]
    rows = [(f"r{rng.randint(0, 7)}", f"p{k}", at(rng.randint(-100, 1000))) for k in range(800)]
    rows += [("hot", f"h{k}", at(7 * 24 + k % 3 - 1)) for k in range(900)] + [("r1", "timeless", None), (None, "rootless", at(50))]
    df = spark.createDataFrame(versions, "dir_name string, valid_from timestamp_ntz, retention_hours int")
    for days in (1, 7, 1000):
        found = scoped.with_dated_policy(files(spark, rows), df, 24, dt.timedelta(days=days)).collect()
        assert len(found) == len(rows)
        for r in found:
            before = [(t, h) for d, t, h in versions if d == r["dir_name"] and None not in (d, t, h) and r["mtime"] and t <= r["mtime"]]
            assert r["retention_hours"] == (max(before)[1] if before else 24), r


def test_a_key_with_most_rows_is_not_shuffled(spark):
    rows = spark.createDataFrame([(k, 5 if k % 3 else k) for k in range(6000)], "id long, key long")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "key * 2 AS twice")
    found = joins.join_per_key(rows, counts, "key", "n")
    assert all(r["twice"] == 2 * r["key"] for r in found.collect()) and found.count() == 6000
