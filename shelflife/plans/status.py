"""Status of roots: sizes, violations, oldest file."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from shelflife.operators.stats import dir_stats, stats_for_roots, status_report, status_summary
from shelflife.session import bound_run_dir
from shelflife.sources.tree import existing_roots, rooted, walk_inventory


class Status(NamedTuple):
    stats: DataFrame
    report: DataFrame
    summary: DataFrame
    run_dir: str | None = None


def inventory_status(inventory: DataFrame, roots: DataFrame, as_of: dt.datetime, hours: int) -> Status:
    """Statistics, lines and verdict for the given roots that exist."""
    stats = stats_for_roots(roots.select("dir_name"), dir_stats(inventory, as_of, hours))
    return Status(stats, status_report(stats), status_summary(stats, hours))


def tree_status(
    spark: SparkSession,
    roots: dict[str, str],
    as_of: dt.datetime,
    hours: int,
    run_dir: str | None = None,
) -> Status:
    """The same for file trees; a missing root has no line."""
    roots = rooted(roots)
    run_dir = bound_run_dir(spark, run_dir, "status", roots=roots)
    inventory = walk_inventory(spark, roots, f"{run_dir}/walk")
    return inventory_status(inventory, existing_roots(spark, roots), as_of, hours)._replace(run_dir=run_dir)
