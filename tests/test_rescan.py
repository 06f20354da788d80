"""A second scan reads what changed and finds what a full scan finds."""

from __future__ import annotations

import os

from shelflife.operators import detect
from shelflife.plans import rescan
from shelflife.plans.scan import scan_trees
from shelflife.sources.tree import roots_below
from trees import put

TOKEN = "AKIA" + "{:016d}"


def found(df):
    return sorted((os.path.basename(r["item"]), r["category"], r["position"], r["secret"]) for r in df.collect())


def test_only_what_changed_is_read(spark, base, tmp_path):
    roots, state = roots_below(str(base)), str(tmp_path / "state")
    for k in range(20):
        put(base / "debug" / f"f{k}", f"key {TOKEN.format(k)} sk-{'a' * 20}", hours_old=k)
    first = rescan.rescan_trees(spark, roots, state)
    assert first.number == 1 and first.changed.count() == 20 and len(found(first.findings)) == 40

    # A file with another text but the same size and time shows that nothing is read.
    put(base / "debug" / "f1", f"key {TOKEN.format(77)} sk-{'b' * 20}", hours_old=1)
    second = rescan.rescan_trees(spark, roots, state)
    assert second.changed.count() == 0 and found(second.findings) == found(first.findings)
    put(base / "debug" / "f1", f"key {TOKEN.format(1)} sk-{'a' * 20}", hours_old=1)

    put(base / "debug" / "f2", f"none any more {'x' * 30}", hours_old=0)
    put(base / "todos" / "new", f"{TOKEN.format(5)} {TOKEN.format(6)}", hours_old=0)
    os.unlink(base / "debug" / "f3")
    third = rescan.rescan_trees(spark, roots, state)
    whole = scan_trees(spark, roots)
    assert sorted(os.path.basename(r["path"]) for r in third.changed.collect()) == ["f2", "new"]
    assert found(third.findings) == found(whole.findings)
    assert sorted(map(tuple, third.summary.collect())) == sorted(map(tuple, whole.summary.collect()))
    assert sorted(map(tuple, third.advice.collect())) == sorted(map(tuple, whole.advice.collect()))

    # Other detectors, or another version of one that is a function, look at everything.
    more = detect.from_patterns({"Words": "none any more"})
    fourth = rescan.rescan_trees(spark, roots, state, more)
    assert fourth.changed.count() == 20 and ("f2", "Words", 0, "none any more") in found(fourth.findings)
    assert rescan.rescan_trees(spark, roots, state, more, version="2").changed.count() == 20


def test_an_interrupted_scan_is_finished(spark, base, tmp_path, monkeypatch):
    roots, state = roots_below(str(base)), str(tmp_path / "state")
    put(base / "debug" / "a", TOKEN.format(1))
    rescan.rescan_trees(spark, roots, state)
    put(base / "debug" / "b", TOKEN.format(2))
    real = rescan.write_once

    def killed(df, path, *args, **options):
        if path.endswith("/unread"):
            raise RuntimeError("killed")
        return real(df, path, *args, **options)

    monkeypatch.setattr(rescan, "write_once", killed)
    try:
        rescan.rescan_trees(spark, roots, state)
    except RuntimeError:
        pass
    monkeypatch.undo()
    done = rescan.rescan_trees(spark, roots, state)
    assert done.number == 2 and [f[0] for f in found(done.findings)] == ["a", "b"]
