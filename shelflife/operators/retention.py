"""Selection by age: what is expired, what stays, and the plan of a purge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from shelflife.functions.messages import file_message
from shelflife.functions.times import (
    as_of_literal,
    cutoff,
    is_expired,
    is_retained,
    time_type,
)
from shelflife.operators.joins import join_root_rows
from shelflife.operators.policy import DEFAULTS, overlay
from shelflife.sources.tables import files_only


def expired_flag(df: DataFrame, as_of: dt.datetime, hours: int | Column, time: str = "mtime") -> Column:
    return is_expired(F.col(time), as_of_literal(as_of, time_type(df, time)), hours)


def expired_files(
    inventory: DataFrame,
    as_of: dt.datetime,
    hours: int | Column,
    partition_date: str | None = None,
) -> DataFrame:
    """Files strictly older than the cutoff.

    With constant hours the predicate reaches the reader. ``partition_date`` names a partition column that
    holds the date of the time (in the session's zone); the bound it implies prunes whole partitions
    before any file opens.
    """
    out = files_only(inventory).where(expired_flag(inventory, as_of, hours))
    if partition_date:
        bound = cutoff(as_of_literal(as_of, time_type(inventory)), hours)
        out = out.where(F.col(partition_date) <= F.to_date(bound))
    return out


def expired_by_policy(inventory: DataFrame, policy: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Files older than the window of their own root.

    Cutoffs are computed once per policy row. The latest of them is a bound no expired file can miss; as a
    scalar subquery it reaches the reader, so newer rows leave before the join. The join carries no hint:
    the policy side is broadcast only while it is small, beyond that AQE splits a root with most files.
    """
    now = as_of_literal(as_of, time_type(inventory))
    default = F.lit(DEFAULTS["retention_hours"])
    known = overlay(policy).select(
        "dir_name", "retention_hours", cutoff(now, F.col("retention_hours")).alias("_cutoff")
    )
    latest = known.agg(F.greatest(F.max("_cutoff"), cutoff(now, default)).alias("latest")).scalar()
    candidates = files_only(inventory).where(F.col("mtime") < latest)
    return (
        join_root_rows(candidates, known, "left")
        .where(F.col("mtime") < F.coalesce("_cutoff", cutoff(now, default)))
        .withColumn("retention_hours", F.coalesce("retention_hours", default))
        .drop("_cutoff")
    )


def retained_rows(
    table: DataFrame, as_of: dt.datetime, hours: int | Column, time: str = "mtime"
) -> DataFrame:
    """Rows a purge keeps; a row without a time is never purged."""
    return table.where(is_retained(F.col(time), as_of_literal(as_of, time_type(table, time)), hours))


def purge_plan(
    inventory: DataFrame,
    as_of: dt.datetime,
    hours: int | Column,
    dry_run: bool | Column = False,
    partition_date: str | None = None,
) -> DataFrame:
    """The files one run would delete, with the size that counts and the line a dry run prints."""
    flag = dry_run if isinstance(dry_run, Column) else F.lit(dry_run)
    size = F.coalesce("size_bytes", F.lit(0).cast("bigint"))
    raw = ["raw"] if "raw" in inventory.columns else []
    return expired_files(inventory, as_of, hours, partition_date).select(
        *raw,
        "dir_name",
        "path",
        size.alias("size_bytes"),
        "mtime",
        flag.alias("dry_run"),
        file_message(F.col("path"), size, flag).alias("message"),
    )
