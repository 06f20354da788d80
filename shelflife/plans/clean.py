"""One retention run: over file trees with deletion, or over a table inventory as a plan."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelflife.operators.policy import overlay, settings_of
from shelflife.operators.prune import prune_plan
from shelflife.operators.purge import purge_files, remove_folders
from shelflife.operators.retention import expired_flag, purge_plan
from shelflife.operators.stats import purge_summary, purge_total
from shelflife.session import bound_run_dir
from shelflife.sources.tree import rooted, walk_inventory


class CleanRun(NamedTuple):
    plan: DataFrame
    outcome: DataFrame | None
    removed: DataFrame | None
    summary: DataFrame
    total: DataFrame
    run_dir: str | None = None


def effective_settings(
    policy: dict | None = None, hours: int | None = None, dry_run: bool = False
) -> tuple[int, bool]:
    """Hours and dry run of one run: an override of 0 means the policy's hours, a flag only turns on."""
    settings = settings_of(policy)
    return hours or settings["retention_hours"], dry_run or settings["dry_run"]


def settings_by_root(
    roots: dict[str, str], policy: DataFrame, hours: int | None, dry_run: bool
) -> tuple[dict[str, int], dict[str, bool]]:
    """Hours and dry run of every root by a policy table; at most one row per root comes to the driver."""
    known = overlay(policy.where(F.col("dir_name").isin(list(roots))))
    stored = {r["dir_name"]: r.asDict() for r in known.select("dir_name", "retention_hours", "dry_run").collect()}
    settings = {name: effective_settings(stored.get(name), hours, dry_run) for name in roots}
    return {name: h for name, (h, _) in settings.items()}, {name: dry for name, (_, dry) in settings.items()}


def _by_root(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("dir_name")]


def plan_run(
    inventory: DataFrame, as_of: dt.datetime, hours: int, dry_run: bool = True, partition_date: str | None = None
) -> CleanRun:
    """A run over a table inventory: what would go, per root and in total."""
    plan = purge_plan(inventory, as_of, hours, dry_run, partition_date)
    summary = purge_summary(plan, dry_run)
    return CleanRun(plan, None, None, summary, purge_total(summary, hours, dry_run))


def clean_trees(
    spark: SparkSession,
    roots: dict[str, str],
    as_of: dt.datetime,
    hours: int | None = None,
    dry_run: bool = False,
    policy: dict | DataFrame | None = None,
    run_dir: str | None = None,
) -> CleanRun:
    """List the roots, delete what is older than the window, remove emptied directories, sum up.

    ``policy`` is one for all roots, or a policy table with a window and a dry run of each; the texts of the
    total then name the longest window. Roots in a dry run stop after the plan. Everything is written below ``run_dir``; calling again with the same
    folder and arguments finishes an interrupted run instead of starting another, with other arguments it is
    refused.
    """
    roots = rooted(roots)
    if isinstance(policy, DataFrame):
        windows, dry = settings_by_root(roots, policy, hours, dry_run)
    else:
        window, flag = effective_settings(policy, hours, dry_run)
        windows, dry = dict.fromkeys(roots, window), dict.fromkeys(roots, flag)
    run_dir = bound_run_dir(spark, run_dir, "clean", roots=roots, as_of=as_of, hours=windows, dry_run=dry)
    inventory = walk_inventory(spark, roots, f"{run_dir}/walk")
    hours, dry_run = max(windows.values()), all(dry.values())
    # One window for all stays a constant in the plan.
    window = hours if min(windows.values()) == hours else _by_root(windows)
    plan = purge_plan(inventory, as_of, window, _by_root(dry))
    if dry_run:
        summary = purge_summary(plan, dry_run)
        return CleanRun(plan, None, None, summary, purge_total(summary, hours, dry_run), run_dir)
    outcome = purge_files(plan.where(~F.col("dry_run")), roots, run_dir)
    removed = remove_folders(_emptied(inventory, outcome, roots, as_of, window, dry), run_dir)
    counted = ["dir_name", "path", "size_bytes", "deleted"]
    planned = plan.where("dry_run").withColumn("deleted", F.lit(True)).select(counted)
    summary = purge_summary(outcome.select(counted).unionByName(planned) if any(dry.values()) else outcome, _by_root(dry))
    return CleanRun(plan, outcome, removed, summary, purge_total(summary, hours, dry_run), run_dir)


def _emptied(
    inventory: DataFrame, outcome: DataFrame, roots: dict[str, str], as_of: dt.datetime, hours: int | Column, dry: dict[str, bool]
) -> DataFrame:
    """The prune plan after a purge: files whose deletion failed still hold their directories.

    What was not expired comes from the inventory and what was from the outcome, so they need no join.
    """
    base = _by_root(roots)
    goes = F.coalesce(expired_flag(inventory, as_of, hours), F.lit(False)) & ~_by_root(dry)
    others = inventory.where(F.col("is_dir") | ~goes)
    tried = outcome.select("dir_name", "path", F.lit(False).alias("is_dir"), "deleted")
    known = others.select("dir_name", "path", "is_dir", F.lit(None).cast("boolean").alias("deleted")).unionByName(tried)
    # A root with expired files is swept even if none of them could be deleted.
    return prune_plan(known, F.col("deleted"), base, expired=F.col("deleted").isNotNull())
