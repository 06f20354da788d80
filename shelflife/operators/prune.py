"""Which directories a purge leaves empty."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from shelflife.functions.times import as_of_literal, is_expired, time_type


def _levels(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def _parent(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.left(path, F.length(path) - F.length(name) - 1)


def _ancestors(path: Column, base: Column) -> Column:
    """``path`` and every directory above it that lies strictly below ``base``."""
    parts = F.split(path, "/")
    first, last = _levels(base) + 1, F.size(parts)
    depths = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(depths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def prune_plan(
    inventory: DataFrame,
    goes: Column,
    base: Column,
    has_dir_rows: bool = True,
    expired: Column | None = None,
) -> DataFrame:
    """Directories below each root that hold nothing once the files flagged ``goes`` are deleted.

    ``goes`` is a boolean over the inventory (NULL counts as staying), ``base`` the path of the root as an
    expression over ``dir_name``. A root without any ``expired`` file (by default: any that goes) is left
    alone, so directories that were empty before stay there too. Files are first reduced to the directories
    that hold them, with partial aggregation, and only those rows are expanded to their ancestors.
    ``has_dir_rows=False`` says that the inventory lists files only; every candidate then has a file that
    goes and the check of the roots is not needed.
    """
    is_file, going = ~F.col("is_dir"), F.coalesce(goes, F.lit(False))
    triggers = going if expired is None else F.coalesce(expired, F.lit(False))
    holders = (
        inventory.select(
            "dir_name",
            F.when(is_file, _parent(F.col("path"))).otherwise(F.col("path")).alias("holder"),
            (is_file & ~going).alias("stays"),
            (is_file & triggers).alias("triggers"),
        )
        .groupBy("dir_name", "holder")
        .agg(F.bool_or("stays").alias("stays"), F.bool_or("triggers").alias("triggers"))
    )
    emptied = (
        holders.select("dir_name", "stays", F.explode(_ancestors(F.col("holder"), base)).alias("path"))
        .groupBy("dir_name", "path")
        .agg(F.bool_or("stays").alias("stays"))
        .where(~F.col("stays"))
        .select("dir_name", "path", (_levels(F.col("path")) - _levels(base)).alias("depth"))
    )
    if not has_dir_rows:
        return emptied
    # One row per root, from the aggregate above, so the inventory is read once.
    touched = holders.groupBy("dir_name").agg(F.bool_or("triggers").alias("touched")).where("touched")
    return emptied.join(touched, "dir_name", "left_semi")


def prune_plan_at(
    inventory: DataFrame,
    as_of: dt.datetime,
    hours: int | Column,
    base: Column,
    has_dir_rows: bool = True,
) -> DataFrame:
    """:func:`prune_plan` for a purge of everything older than the window."""
    goes = is_expired(F.col("mtime"), as_of_literal(as_of, time_type(inventory)), hours)
    return prune_plan(inventory, goes, base, has_dir_rows)


def children_first(plan: DataFrame) -> DataFrame:
    """Order in which the directories can be removed one by one."""
    return plan.orderBy(F.desc("depth"), F.desc("path"))
