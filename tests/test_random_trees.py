"""Whole runs over random trees against a plain statement of what must be left."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest

from shelflife.plans.clean import clean_trees
from shelflife.plans.status import tree_status
from shelflife.sources.tree import roots_below
from trees import AS_OF, put


def grow(base: Path, rng: random.Random) -> dict[str, tuple[int, float]]:
    """Random files and empty folders; returns size and age by path."""
    files = {}
    for name in ("debug", "projects", "todos"):
        root = base / name
        for _ in range(rng.randrange(0, 40)):
            depth = rng.randrange(0, 5)
            folder = root.joinpath(*[rng.choice("abc") for _ in range(depth)])
            if rng.random() < 0.2:
                folder.mkdir(parents=True, exist_ok=True)
                continue
            path = folder / f"f{rng.randrange(1000)}"
            size, age = rng.randrange(0, 5000), rng.choice([0.5, 23.9, 24, 24.1, 100])
            put(path, "x" * size, age)
            files[str(path)] = (size, age)
    return files


def snapshot(base: Path) -> set[str]:
    return {str(p) for p in base.rglob("*")}


def expected_left(base: Path, files: dict[str, tuple[int, float]]) -> set[str]:
    left = snapshot(base)
    for name in ("debug", "projects", "todos"):
        root = str(base / name)
        gone = {p for p, (_, age) in files.items() if p.startswith(root + "/") and age > 24}
        left -= gone
        if gone:
            folders = [p for p in left if p.startswith(root + "/") and p not in files]
            kept = [p for p in left if p in files]
            left -= {f for f in folders if not any(k.startswith(f + "/") for k in kept)}
    return left


@pytest.mark.parametrize("seed", range(4))
def test_clean_and_status(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = tmp_path / "logs"
    names = ["debug", "projects", "todos"]
    for name in names:
        (base / name).mkdir(parents=True)
    files = grow(base, rng)
    roots = roots_below(str(base), names)

    status = tree_status(spark, roots, AS_OF, 24, str(tmp_path / "status"))
    stats = {r["dir_name"]: r for r in status.stats.collect()}
    for name in names:
        mine = [v for p, v in files.items() if p.startswith(str(base / name) + "/")]
        assert stats[name]["file_count"] == len(mine)
        assert stats[name]["total_size"] == sum(size for size, _ in mine)
        assert stats[name]["violations"] == sum(age > 24 for _, age in mine)
        oldest = max((age for _, age in mine), default=None)
        assert stats[name]["max_age_hours"] == (None if oldest is None else pytest.approx(oldest, abs=1e-9))

    left = expected_left(base, files)
    run = clean_trees(spark, roots, AS_OF, run_dir=str(tmp_path / "run"))
    assert snapshot(base) == left
    gone = [size for size, age in files.values() if age > 24]
    total = run.total.first()
    assert (total["files"], total["bytes"]) == (len(gone), sum(gone))
    assert all(r["removed"] for r in run.removed.collect())
    assert os.path.isdir(base / "debug")
