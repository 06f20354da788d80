from __future__ import annotations

import hashlib
import os
import re

import pytest

from shelflife.operators import detect
from shelflife.operators.purge import FILE_OUTCOME, _unlink, purge_files, remove_folders
from shelflife.operators.retention import purge_plan
from shelflife.plans.clean import clean_trees
from shelflife.plans.scan import scan_files, scan_trees
from shelflife.sources.tree import roots_below, walk_inventory
from trees import AS_OF, put, touch


def clean(spark, base, run_dir, **kwargs):
    return clean_trees(spark, roots_below(str(base)), AS_OF, run_dir=str(run_dir), **kwargs)


def test_old_goes_new_stays(spark, base, tmp_path):
    old = put(base / "debug" / "old.log", "old content", 48)
    new = put(base / "debug" / "new.log", "new content", 0)
    edge = put(base / "debug" / "edge.log", "x", 24)
    run = clean(spark, base, tmp_path / "run")
    assert (old.exists(), new.exists(), edge.exists()) == (False, True, True)
    total = run.total.first()
    assert (total["files"], total["bytes"], total["retention_hours"]) == (1, 11, 24)
    assert total["message"] == "Cleanup complete: 1 files processed"
    assert total["session_message"] == "[retention] Cleaned 1 files (11 B freed)"
    assert total["start"] == "Starting cleanup (retention: 24h, dry_run: False)"
    assert run.summary.first()["message"] == "debug: Deleted 1 files (11 B freed)"


def test_dry_run_touches_nothing(spark, base, tmp_path):
    old = put(base / "debug" / "sub" / "old.log", "old content", 48)
    for run in (
        clean(spark, base, tmp_path / "a", dry_run=True),
        clean(spark, base, tmp_path / "b", policy={"dry_run": True}),
    ):
        assert run.total.first()["files"] == 1
        assert run.plan.first()["message"] == f"[DRY RUN] Would delete: {old} (11 B)"
        assert run.total.first()["session_message"] == "[retention] Would clean 1 files (11 B)"
    assert old.exists()


def test_nothing_expired(spark, base, tmp_path):
    put(base / "debug" / "new.log", "new content", 0)
    (base / "debug" / "empty").mkdir()
    run = clean(spark, base, tmp_path / "run")
    assert run.total.first()["message"] == "No files older than 24h found"
    assert (base / "debug" / "empty").exists()


def test_override(spark, base, tmp_path):
    old = put(base / "debug" / "old.log", "x", 30)
    assert clean(spark, base, tmp_path / "a", hours=0, policy={"retention_hours": 48}).total.first()["files"] == 0
    assert clean(spark, base, tmp_path / "b", hours=29).total.first()["files"] == 1
    assert not old.exists()
    future = put(base / "debug" / "future.log", "x", -1)
    assert clean(spark, base, tmp_path / "c", hours=-2).total.first()["files"] == 1
    assert not future.exists()


def test_emptied_directories_go_and_roots_stay(spark, base, tmp_path):
    put(base / "projects" / "p" / "q" / "old", "x", 48)
    put(base / "projects" / "p" / "r" / "old", "x", 48)
    put(base / "projects" / "k" / "new", "x", 1)
    put(base / "projects" / "k" / "z" / "old", "x", 48)
    (base / "projects" / "empty" / "inner").mkdir(parents=True)
    (base / "todos" / "empty").mkdir()
    run = clean(spark, base, tmp_path / "run")
    left = sorted(os.path.relpath(p, base) for p, _, _ in os.walk(base / "projects"))
    assert left == ["projects", "projects/k"]
    assert (base / "todos" / "empty").exists()
    assert {os.path.relpath(r["path"], base): r["removed"] for r in run.removed.collect()} == {
        f"projects/{d}": True for d in ("p", "p/q", "p/r", "k/z", "empty", "empty/inner")
    }


def test_link_goes_and_its_target_stays(spark, base, tmp_path):
    target = put(tmp_path / "outside" / "target", "7777777", 48)
    os.symlink(target, base / "debug" / "link")
    total = clean(spark, base, tmp_path / "run").total.first()
    assert (total["files"], total["bytes"]) == (1, 7)
    assert target.exists() and not os.path.lexists(base / "debug" / "link")


def test_folder_with_something_else_inside_stays(spark, base, tmp_path):
    put(base / "debug" / "d" / "old", "x", 48)
    os.symlink(tmp_path / "nowhere", base / "debug" / "d" / "broken")
    run = clean(spark, base, tmp_path / "run")
    assert (base / "debug" / "d").exists()
    assert [r["removed"] for r in run.removed.collect()] == [False]


def plan_of(spark, base, tmp_path):
    roots = roots_below(str(base))
    return roots, purge_plan(walk_inventory(spark, roots, str(tmp_path / "walk")), AS_OF, 24)


def test_file_changed_since_the_listing_stays(spark, base, tmp_path):
    busy = put(base / "debug" / "busy", "x", 48)
    put(base / "debug" / "gone", "x", 48).touch()
    touch(base / "debug" / "gone", 48)
    roots, plan = plan_of(spark, base, tmp_path)
    plan.count()
    touch(busy, 0)
    (base / "debug" / "gone").unlink()
    outcome = {os.path.basename(r["path"]): (r["deleted"], r["error"]) for r in
               purge_files(plan, roots, str(tmp_path / "run")).collect()}
    assert outcome == {"busy": (False, "changed since listed"), "gone": (False, "already gone")}
    assert busy.exists()


def test_path_outside_its_root_is_refused(spark, base, tmp_path):
    victim = put(tmp_path / "elsewhere" / "v", "x", 48)
    sly = base / "debug" / ".." / ".." / "elsewhere" / "v"
    roots = roots_below(str(base))
    for n, (name, path) in enumerate((("debug", victim), ("debug", sly), ("unknown", victim))):
        at = f"timestamp_micros({os.stat(victim).st_mtime_ns // 1000})"
        plan = spark.sql(f"SELECT '{name}' dir_name, '{path}' path, 1L size_bytes, {at} mtime")
        row = purge_files(plan, roots, str(tmp_path / f"run{n}")).first()
        assert (row["deleted"], row["error"]) == (False, "outside its root")
    assert victim.exists()


def test_lost_task_is_counted_once(spark, base, tmp_path):
    """The first attempt of every task deletes its files and dies before its result is kept."""
    for n in range(50):
        put(base / "debug" / str(n), "xx", 48)
    roots, plan = plan_of(spark, base, tmp_path)
    staged = plan.selectExpr("dir_name", "path", "raw", "size_bytes", "unix_micros(mtime) micros")
    staged.repartition(4).write.parquet(str(tmp_path / "staged"))

    def die_once(batches):
        from pyspark import TaskContext

        done = list(batches)
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("executor lost")
        yield from done

    outcome = (
        spark.read.parquet(str(tmp_path / "staged"))
        .mapInPandas(_unlink(roots, may_have_run=False), FILE_OUTCOME)
        .mapInPandas(die_once, FILE_OUTCOME)
    )
    outcome.write.parquet(str(tmp_path / "outcome"))
    kept = spark.read.parquet(str(tmp_path / "outcome"))
    assert kept.where("deleted").count() == 50
    assert os.listdir(base / "debug") == []


def test_interrupted_run_is_finished_and_not_repeated(spark, base, tmp_path):
    for n in range(20):
        put(base / "debug" / "d" / str(n), "xx", 48)
    run_dir = tmp_path / "run"
    roots = roots_below(str(base))
    plan = purge_plan(walk_inventory(spark, roots, str(run_dir / "walk")), AS_OF, 24)
    purge_files(plan, roots, str(run_dir))
    # As if the driver had died before the outcome was committed.
    (run_dir / "outcome" / "_SUCCESS").unlink()
    run = clean_trees(spark, roots, AS_OF, run_dir=str(run_dir))
    assert run.total.first()["files"] == 20
    assert not (base / "debug" / "d").exists()
    put(base / "debug" / "later", "xx", 48)
    again = clean_trees(spark, roots, AS_OF, run_dir=str(run_dir))
    assert again.total.first()["files"] == 20
    assert (base / "debug" / "later").exists()


def test_counting_the_outcome_deletes_nothing_more(spark, base, tmp_path):
    put(base / "debug" / "old", "x", 48)
    roots, plan = plan_of(spark, base, tmp_path)
    outcome = purge_files(plan, roots, str(tmp_path / "run"))
    put(base / "debug" / "old", "x", 48)
    assert outcome.count() == 1 and outcome.where("deleted").count() == 1
    assert (base / "debug" / "old").exists()


def test_folder_that_filled_up_meanwhile_stays(spark, base, tmp_path):
    put(base / "debug" / "d" / "e" / "f", "x")
    plan = spark.createDataFrame(
        [("debug", str(base / "debug" / "d" / "e"), 2), ("debug", str(base / "debug" / "d"), 1)],
        "dir_name string, path string, depth int",
    )
    assert [r["removed"] for r in remove_folders(plan, str(tmp_path / "run")).collect()] == [False, False]


TOKEN = "AKIA" + "Q" * 16


def scanned(spark, base, run_dir, extra=(), split=None, **more):
    scan = scan_trees(spark, roots_below(str(base)), extra, run_dir=str(run_dir), split_bytes=split, **more)
    found = sorted((os.path.basename(r["item"]), r["category"], r["position"], r["secret"]) for r in scan.findings.collect())
    return scan, found


def test_scan_does_not_depend_on_the_split(spark, base, tmp_path):
    """Multi-line, anchored and grouped detectors, a file without line breaks, characters of several bytes."""
    block = "BEGIN\n" + "body\n" * 20 + "END"
    put(base / "debug" / "text", "filler é\n" * 130 + block + "\n" + f"KEY={TOKEN}\n" + "filler 😀\n" * 60 + block + f" {TOKEN}")
    put(base / "debug" / "long", ("x😀" * 200 + f" {TOKEN} ") * 3 + "id=42")
    put(base / "plans" / "bytes", b"\xff\xfe" * 700 + f" {TOKEN} ".encode() + b"\xff" * 50)
    extra = [
        detect.Detector("Blocks", "(?s)BEGIN.*?END", span=200),
        detect.Detector("Starts", "^filler", span=100),
        detect.Detector("Numbers", "id=([0-9]+)", group=1, span=100),
        detect.Detector("Ends", "[A-Z]+$", span=None),
        detect.BatchDetector("Batch", lambda texts: texts.map(re.compile("KEY=").findall)),
    ]
    builtin_span = {"span": 300}
    monkey = [detect.Detector(d.category, d.pattern, d.literals, d.group, **builtin_span) for d in detect.BUILTIN_DETECTORS]
    inventory = walk_inventory(spark, roots_below(str(base)), str(tmp_path / "walk"))
    roots = spark.createDataFrame([("debug",), ("plans",)], "dir_name string")
    expected = None
    for split in (None, 64, 1000, *range(1400, 1461, 15), 1 << 24):
        scan = scan_files(inventory, roots, str(tmp_path / str(split)), extra, monkey, split_bytes=split)
        found = sorted((os.path.basename(r["item"]), r["category"], r["position"], r["secret"]) for r in scan.findings.collect())
        expected = expected or found
        assert found == expected, split
    categories = sorted((item, category) for item, category, *_ in expected)
    assert categories == sorted(
        [("text", "Blocks")] * 2 + [("text", "Starts"), ("text", "Batch"), ("text", "Ends"), ("long", "Numbers"), ("bytes", "AWS Keys")]
        + [("text", "AWS Keys")] * 2 + [("long", "AWS Keys")] * 3
    )
    assert [p for item, category, p, _ in expected if (item, category) == ("long", "AWS Keys")] == [0, 1, 2]


def test_scan_of_trees(spark, base, tmp_path):
    put(base / "debug" / ".env", f"KEY={TOKEN}\n" + "filler\n" * 100 + f"again {TOKEN}\n")
    put(base / "debug" / "big", ("line of text\n" * 500 + f"{TOKEN}\n") * 3)
    put(base / "todos" / "clean", "nothing")
    with open(os.fsencode(base / "debug") + b"/bad\xff", "wb") as f:
        f.write(TOKEN.encode())
    (base / "plans").rmdir()
    scan, found = scanned(spark, base, tmp_path / "a", split=1000)
    assert [tuple(r) for r in scan.summary.collect()] == [("debug", "AWS Keys", 6, 3)]
    assert scan.run_dir == str(tmp_path / "a") and scan.unread.count() == 0
    advice = {r["dir_name"]: (r["matches"], r["cleanup_advised"]) for r in scan.advice.collect()}
    assert advice["debug"] == (6, True) and advice["todos"] == (0, False) and "plans" not in advice
    # A detector of another category leaves the counts as they were, one of the same category adds none.
    _, more = scanned(spark, base, tmp_path / "b", detect.from_patterns({"Tickets": "T-[0-9]+"}), 1000)
    assert more == found
    _, same = scanned(spark, base, tmp_path / "c", detect.from_patterns({"AWS Keys": "AKIA[A-Z]{16}"}), 1000)
    assert {(item, secret) for item, _, _, secret in same} == {(item, secret) for item, _, _, secret in found} and len(same) == 3
    _, hidden = scanned(spark, base, tmp_path / "d", split=1000, digest=True)
    assert [s for *_, s in hidden] == [hashlib.sha256(TOKEN.encode()).hexdigest()] * 6
    with pytest.raises(ValueError):
        scanned(spark, base, tmp_path / "d", split=1000)


def test_files_that_cannot_be_read_are_reported(spark, base, tmp_path):
    put(base / "debug" / "there", TOKEN)
    gone = put(base / "debug" / "gone", TOKEN)
    inventory = walk_inventory(spark, roots_below(str(base)), str(tmp_path / "walk"))
    gone.unlink()
    scan = scan_files(inventory, spark.createDataFrame([("debug",)], "dir_name string"), str(tmp_path / "run"))
    assert scan.findings.count() == 1
    assert [(os.path.basename(r["item"]), r["error"]) for r in scan.unread.collect()] == [("gone", "FileNotFoundError")]


def test_names_that_are_no_utf8_are_purged(spark, base, tmp_path):
    raw = os.fsencode(base / "debug") + b"/bad\xff"
    with open(raw, "wb") as f:
        f.write(b"x")
    os.utime(raw, (0, 0))
    run = clean_trees(spark, {"debug": f"{base}/debug/"}, AS_OF, run_dir=str(tmp_path / "run"))
    assert run.total.first()["files"] == 1 and not os.path.exists(raw)


def test_a_root_with_a_slash_is_pruned_alike(spark, base, tmp_path):
    put(base / "debug" / "d" / "e" / "f", "x", 48)
    run = clean_trees(spark, {"debug": f"{base}/debug/"}, AS_OF, run_dir=str(tmp_path / "run"))
    removed = sorted((os.path.relpath(r["path"], base), r["depth"], r["removed"]) for r in run.removed.collect())
    assert removed == [("debug/d", 1, True), ("debug/d/e", 2, True)]


def test_a_policy_table_gives_each_root_its_window(spark, base, tmp_path):
    for root in ("debug", "plans", "todos", "projects"):
        put(base / root / "d" / "f", "xx", 30)
    table = [("debug", 24, None), ("plans", 48, None), ("todos", 24, True), ("elsewhere", 1, None)]
    policy = spark.createDataFrame(table, "dir_name string, retention_hours int, dry_run boolean")
    run = clean(spark, base, tmp_path / "run", policy=policy)
    assert [(base / r / "d").exists() for r in ("debug", "plans", "todos", "projects")] == [False, True, True, False]
    messages = {r["dir_name"]: (r["files"], r["message"]) for r in run.summary.collect()}
    assert messages["debug"] == (1, "debug: Deleted 1 files (2 B freed)") and messages["projects"][0] == 1
    assert messages["todos"][0] == 1 and "Deleted" not in messages["todos"][1] and "plans" not in messages
    assert sorted(os.path.relpath(r["path"], base) for r in run.removed.collect()) == ["debug/d", "projects/d"]
    assert run.total.first()["retention_hours"] == 48
    dry = clean(spark, base, tmp_path / "dry", policy=policy, dry_run=True)
    assert dry.outcome is None and [r["dir_name"] for r in dry.plan.collect()] == ["todos"]


def test_a_run_folder_belongs_to_one_run(spark, base, tmp_path):
    put(base / "debug" / "f", "x", 30)
    roots, run_dir = roots_below(str(base)), str(tmp_path / "run")
    assert clean_trees(spark, roots, AS_OF, hours=40, run_dir=run_dir).run_dir == run_dir
    with pytest.raises(ValueError):
        clean_trees(spark, roots, AS_OF, hours=24, run_dir=run_dir)
    assert clean_trees(spark, roots, AS_OF, hours=40, run_dir=run_dir).total.first()["files"] == 0


def test_second_copy_of_a_task_counts_what_the_first_deleted(spark, base, tmp_path, monkeypatch):
    gone = put(base / "debug" / "gone", "x", 48)
    roots, plan = plan_of(spark, base, tmp_path)
    gone.unlink()
    get = type(spark.sparkContext.getConf()).get
    monkeypatch.setattr(
        type(spark.sparkContext.getConf()),
        "get",
        lambda self, key, default=None: "true" if key == "spark.speculation" else get(self, key, default),
    )
    assert [r["deleted"] for r in purge_files(plan, roots, str(tmp_path / "run")).collect()] == [True]
