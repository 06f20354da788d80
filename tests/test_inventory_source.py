"""The data source lists what the walk lists, and takes the bounds of a query."""

from __future__ import annotations

import json
import os

import pytest

from shelflife.sources import inventory_source
from shelflife.sources.tree import roots_below, walk_inventory
from trees import put


@pytest.fixture
def tree(base, tmp_path):
    debug = base / "debug"
    for k in range(300):
        put(debug / "flat" / f"f{k}", "x" * k, k)
    put(debug / ".dot" / "deep" / "er" / "y", "333", 3)
    put(base / "todos" / "zero", "", 4)
    (debug / "void").mkdir()
    os.symlink(put(tmp_path / "outside" / "target", "7777777", 50), debug / "link")
    os.symlink(tmp_path / "outside", debug / "dirlink")
    os.symlink(tmp_path / "gone", debug / "broken")
    put(os.fsencode(debug) and debug / os.fsdecode(b"odd\xff"), "1", 1)
    return base


def load(spark, base, **options):
    inventory_source.register(spark)
    reader = spark.read.format("file_inventory").option("base", str(base))
    return reader.options(**options).load()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 8, 1000])
def test_equal_to_the_walk(spark, tree, tmp_path, monkeypatch, partitions):
    walked = walk_inventory(spark, roots_below(str(tree)), str(tmp_path / "run"))
    found = load(spark, tree, partitions=partitions)
    assert found.schema.simpleString() == walked.schema.simpleString()
    assert rows(found) == rows(walked.select(found.columns))


def test_a_flat_folder_is_read_by_several_tasks(tree, monkeypatch):
    monkeypatch.setattr(inventory_source, "ENTRIES", 50)
    reader = inventory_source.InventoryReader({"base": str(tree)})
    parts = reader.partitions()
    shares = [p for p in parts if p.folder.endswith(b"flat")]
    assert len(shares) == 6 and not any(p.deep for p in shares)
    found = [r[1] for p in parts for r in reader._rows(p)]
    assert len(found) == len(set(found)) == 304 + 5
    assert max(sum(1 for _ in reader._rows(p)) for p in shares) < 80


def test_bounds_reach_the_listing(spark, tree, capsys):
    whole = load(spark, tree)
    bounds = "mtime < timestamp'2025-06-05 12:00:00 UTC' AND size_bytes >= 250 AND NOT is_dir AND dir_name = 'debug'"
    found = whole.where(bounds)
    assert sorted(r["size_bytes"] for r in found.collect()) == list(range(250, 300))
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThan(mtime" in plan.split("PushedFilters")[1]
    # What was taken from the query is not tested again.
    assert "Filter (" not in plan
    assert whole.where("size_bytes is null").count() == whole.where("is_dir").count() == 5
    assert whole.where("dir_name in ('todos', 'plans')").count() == 1


def test_roots_that_cannot_match_are_not_listed(tree):
    from pyspark.sql.datasource import EqualTo, Not, StringStartsWith

    reader = inventory_source.InventoryReader({"base": str(tree)})
    left = list(reader.pushFilters([EqualTo(("dir_name",), "todos"), StringStartsWith(("path",), "/"), Not(EqualTo(("is_dir",), True))]))
    assert left == [StringStartsWith(("path",), "/")]
    assert {p.dir_name for p in reader.partitions()} == {"todos"}


def test_in_sql(spark, tree):
    inventory_source.register(spark)
    options = json.dumps(roots_below(str(tree))).replace("'", "")
    spark.sql(f"CREATE TEMPORARY VIEW trees USING file_inventory OPTIONS (roots '{options}')")
    assert spark.sql("SELECT count(*) FROM trees WHERE NOT is_dir").first()[0] == 304
    spark.sql("DROP VIEW trees")


def test_missing_and_blocked_roots(spark, tmp_path):
    assert load(spark, tmp_path / "nowhere").collect() == []
    with pytest.raises(Exception, match="absolute"):
        load(spark, "relative").collect()
