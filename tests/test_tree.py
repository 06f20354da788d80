from __future__ import annotations

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelflife.plans.status import tree_status
from shelflife.sources.content import file_content
from shelflife.sources.tree import DEFAULT_ROOTS, _list_folders, existing_roots, roots_below, walk_inventory
from trees import AS_OF, put


def walk(spark, base, tmp_path, names=None):
    return walk_inventory(spark, roots_below(str(base), names), str(tmp_path / "run"))


def test_empty_roots(spark, base, tmp_path):
    found = walk(spark, base, tmp_path)
    assert found.count() == 0
    assert found.columns == ["dir_name", "path", "size_bytes", "mtime", "is_dir", "stat_ok", "raw"]


def test_missing_roots_are_no_error(spark, tmp_path):
    roots = roots_below(str(tmp_path / "nowhere"))
    assert walk_inventory(spark, roots, str(tmp_path / "run")).count() == 0
    assert existing_roots(spark, roots).count() == 0
    status = tree_status(spark, roots, AS_OF, 24, str(tmp_path / "run2"))
    assert status.report.count() == 0
    assert status.summary.first()["verdict"] == "✓ No retention violations"


def test_everything_a_tree_can_hold(spark, base, tmp_path):
    debug = base / "debug"
    put(debug / "a.log", "12345", 48)
    put(debug / ".hidden", "1", 1)
    put(debug / "_under" / "_x", "22", 2)
    put(debug / ".dot" / "deep" / "er" / "y", "333", 3)
    put(debug / "zero", "", 4)
    (debug / "void").mkdir()
    outside = put(tmp_path / "outside" / "target", "7777777", 50)
    os.symlink(outside, debug / "link")
    os.symlink(tmp_path / "outside", debug / "dirlink")
    os.symlink(tmp_path / "gone", debug / "broken")
    rows = {r["path"]: r for r in walk(spark, base, tmp_path).collect()}
    files = {os.path.relpath(p, debug): r["size_bytes"] for p, r in rows.items() if not r["is_dir"]}
    assert files == {"a.log": 5, ".hidden": 1, "_under/_x": 2, ".dot/deep/er/y": 3, "zero": 0, "link": 7}
    folders = {os.path.relpath(p, debug) for p, r in rows.items() if r["is_dir"]}
    assert folders == {"_under", ".dot", ".dot/deep", ".dot/deep/er", "void"}
    assert {r["dir_name"] for r in rows.values()} == {"debug"}
    assert all(r["stat_ok"] for r in rows.values())


def test_time_to_the_microsecond(spark, base, tmp_path):
    file = put(base / "todos" / "x", "x")
    os.utime(file, ns=(1_700_000_000_123_456_789, 1_700_000_000_123_456_789))
    row = walk(spark, base, tmp_path).select(F.unix_micros("mtime")).first()
    assert row[0] == 1_700_000_000_123_456


def test_a_flat_and_a_lopsided_tree(spark, base, tmp_path):
    for n in range(3000):
        put(base / "debug" / f"{n}.log", "x")
    deep = base / "projects"
    for n in range(12):
        deep = deep / str(n)
        put(deep / "f", "xx")
    found = walk(spark, base, tmp_path).where(~F.col("is_dir")).groupBy("dir_name").count().collect()
    assert {r[0]: r[1] for r in found} == {"debug": 3000, "projects": 12}


def test_name_that_is_no_utf8(spark, base, tmp_path):
    put(base / "plans" / "good", "x", 48)
    with open(os.fsencode(base / "plans") + b"/bad\xff", "wb") as f:
        f.write(b"x")
    os.mkdir(os.fsencode(base / "plans") + b"/dir\xfe")
    with open(os.fsencode(base / "plans") + b"/dir\xfe/inner", "wb") as f:
        f.write(b"x")
    rows = {os.path.relpath(r["path"], base / "plans"): r for r in walk(spark, base, tmp_path).collect()}
    assert {p: (r["is_dir"], r["stat_ok"], r["mtime"] is None) for p, r in rows.items()} == {
        "good": (False, True, False),
        "bad\\xff": (False, True, False),
        "dir\\xfe": (True, True, False),
        "dir\\xfe/inner": (False, True, False),
    }
    assert rows["bad\\xff"]["raw"] == os.fsencode(base / "plans") + b"/bad\xff" and rows["good"]["raw"] is None
    stats = tree_status(spark, roots_below(str(base), ["plans"]), AS_OF, 24, str(tmp_path / "status")).stats.first()
    assert (stats["file_count"], stats["total_size"], stats["violations"]) == (3, 3, 1)


def test_status(spark, base, tmp_path):
    put(base / "debug" / "one", "content1", 0)
    put(base / "debug" / "two", "content2content2", 0.5)
    put(base / "plans" / "old", "old content", 48)
    (base / "todos").rmdir()
    status = tree_status(spark, roots_below(str(base)), AS_OF, 24, str(tmp_path / "run"))
    stats = {r["dir_name"]: tuple(r)[1:] for r in status.stats.collect()}
    assert set(stats) == set(DEFAULT_ROOTS) - {"todos"}
    assert stats["debug"] == (2, 24, 0, 0.5)
    assert stats["plans"] == (1, 11, 1, 48.0)
    assert stats["projects"] == (0, 0, 0, None)
    assert status.summary.first()["oldest"] == "Oldest file: 48.0 hours ago"


def read(spark, base, tmp_path, split, span=100):
    rows = file_content(walk(spark, base, tmp_path), split, span).collect()
    texts = {}
    for row in sorted(rows, key=lambda r: (r["item"], r["part"])):
        own = row["text"][row["own_from"] : row["own_to"]]
        texts[os.path.basename(row["item"])] = texts.get(os.path.basename(row["item"]), "") + own
    return texts, len(rows)


def test_parts_own_every_character_once(spark, base, tmp_path):
    cases = {
        "lines": "".join(f"line {n} é😀\n" for n in range(2000)),
        "no_end": "a\nb\nc",
        "one_line": "x😀" * 25_000,
        "blank": "\n" * 999,
        "edge": "y" * 511 + "\n" + "z" * 511 + "\n",
        "after": "y" * 512 + "\n" + "z" * 600,
    }
    for name, text in cases.items():
        put(base / "debug" / name, text)
    put(base / "debug" / "nothing", "")
    put(base / "debug" / "bytes", b"ok \xff\xfe end\n\xc3" * 300)
    cases["bytes"] = (b"ok \xff\xfe end\n\xc3" * 300).decode("utf-8", "replace")
    for run, split in enumerate((None, 512, 1000, 1 << 20)):
        texts, rows = read(spark, base, tmp_path / str(run), split)
        assert texts == cases
        assert split != 512 or rows > 50


def test_a_file_without_line_breaks_is_read_about_once(tmp_path, monkeypatch):
    """Bytes asked for by all parts together, and the largest request."""
    import builtins

    from shelflife.sources.content import _read_window

    path, asked = tmp_path / "long", []
    path.write_bytes(b"x" * 4_000_000)
    real = builtins.open

    def counting(*args):
        stream = real(*args)
        read = stream.read
        wrapper = type("S", (), {"seek": stream.seek, "__enter__": lambda s: s, "__exit__": lambda s, *a: stream.close()})()
        wrapper.read = lambda n: asked.append(len(data := read(n))) or data
        return wrapper

    monkeypatch.setattr(builtins, "open", counting)
    for part in range(4):
        _read_window(path, part, 1_000_000, 50_000)
    monkeypatch.undo()
    assert 4_000_000 <= sum(asked) <= 8_000_000 and max(asked) <= 1_100_000


def test_content_of_a_file_that_is_gone(spark, base, tmp_path):
    put(base / "debug" / "stays", "text")
    gone = put(base / "debug" / "goes", "text")
    inventory = walk(spark, base, tmp_path)
    gone.unlink()
    rows = {os.path.basename(r["item"]): (r["text"], r["error"]) for r in file_content(inventory).collect()}
    assert rows == {"stays": ("text", None), "goes": (None, "FileNotFoundError")}


def test_roots_are_spelled_one_way(spark, base, tmp_path):
    put(base / "debug" / "d" / "f", "x")
    plain = walk_inventory(spark, {"debug": f"{base}/debug"}, str(tmp_path / "a")).collect()
    for n, form in enumerate((f"{base}/debug/", f"file://{base}/debug", f"{base}/debug//")):
        assert walk_inventory(spark, {"debug": form}, str(tmp_path / f"b{n}")).collect() == plain
    for bad in ("hdfs://host/logs", "logs/debug"):
        with pytest.raises(ValueError):
            walk_inventory(spark, {"debug": bad}, str(tmp_path / "c"))


def listed(monkeypatch, problem):
    def scandir(path):
        raise problem

    monkeypatch.setattr(os, "scandir", scandir)
    folders = pd.DataFrame({"dir_name": ["debug"], "path": ["/x/sealed"], "raw": [None]})
    return [row for pdf in _list_folders(10)([folders]) for row in pdf.itertuples(index=False, name=None)]


def test_folders_that_cannot_be_listed(spark, base, tmp_path, monkeypatch):
    assert listed(monkeypatch, FileNotFoundError()) == []
    assert listed(monkeypatch, PermissionError()) == [("debug", "/x/sealed", None, "blocked")]
    with pytest.raises(OSError):
        listed(monkeypatch, OSError(5, "I/O error"))
    monkeypatch.undo()
    # As if the folder, listed with its parent, had then refused.
    put(base / "debug" / "sealed" / "f", "x")
    run_dir = tmp_path / "run"
    roots = {"debug": f"{base}/debug"}
    walk_inventory(spark, roots, str(run_dir)).count()
    sealed = [("debug", f"{base}/debug/sealed", None, "blocked")]
    spark.createDataFrame(sealed, "dir_name string, path string, raw binary, kind string").write.mode("overwrite").parquet(
        f"{run_dir}/listing/level=1"
    )
    (run_dir / "inventory" / "_SUCCESS").unlink()
    (run_dir / "listing" / "level=2" / "_SUCCESS").unlink(missing_ok=True)
    rows = [(os.path.basename(r["path"]), r["is_dir"], r["stat_ok"]) for r in walk_inventory(spark, roots, str(run_dir)).collect()]
    assert rows == [("sealed", True, False)]


def test_entry_gone_between_listing_and_measuring(spark, base, tmp_path):
    """A listing is kept across attempts; files that left meanwhile drop out of the inventory."""
    put(base / "debug" / "stays", "text")
    gone = put(base / "debug" / "goes", "text")
    run_dir = tmp_path / "run"
    walk_inventory(spark, roots_below(str(base)), str(run_dir)).count()
    gone.unlink()
    (run_dir / "inventory" / "_SUCCESS").unlink()
    again = walk_inventory(spark, roots_below(str(base)), str(run_dir))
    assert [os.path.basename(r["path"]) for r in again.collect()] == ["stays"]


def test_one_large_file_is_read_by_several_tasks(spark, base, tmp_path):
    put(base / "debug" / "large", "some line\n" * 10_000)
    parts = file_content(walk(spark, base, tmp_path), 10_000, 100)
    tasks = parts.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.count() == 10
