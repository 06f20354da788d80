"""What the plans of the registered queries must and must not hold."""

from __future__ import annotations

from pathlib import Path

import pytest

from shelflife.plans.registered import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")
# These run their stages when called; their plan is only a read of what they wrote.
EAGER = {name for name in QUERIES if name.startswith(("tree_", "session_", "table_purge_applied", "table_purge_layouts"))}
MAP_ONLY = [
    "inventory",
    "expired_files",
    "effective_retention",
    "effective_dry_run",
    "policy_update_outcome",
    "purge_plan",
    "table_purge_retained",
    "format_size",
    "secret_match_flags",
    "secret_findings",
    "secret_custom_detector",
]
# Columns a query may read, where it has no business reading all of them.
READS = {
    "dir_stats": "struct<ts:timestamp_ntz,event_type:string,props:string>",
    "table_purge_partitions": "struct<o_orderdate:timestamp_ntz>",
    "purge_total": "struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>",
}


def plan(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairing_of_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", MAP_ONLY)
def test_map_only(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", READS)
def test_reads_only_what_it_needs(spark, name):
    assert READS[name] in plan(spark, name)


def test_cutoff_is_a_constant_for_the_reader(spark):
    assert "LessThan(ts,2024-01-24T00:00)" in plan(spark, "expired_files")
    assert "Or(IsNull(ts),GreaterThanOrEqual(ts,2024-01-24T00:00))" in plan(spark, "table_purge_retained")


def test_totals_come_from_one_row_per_root(spark):
    text = plan(spark, "purge_rollup")
    assert text.count("Expand") >= 1 and text.index("Expand") < text.index("Scan parquet")
    tree = text[: text.index("\n\n\n")]
    assert tree.index("Expand") < tree.rindex("HashAggregate")
