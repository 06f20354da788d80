"""Counts, sizes, violations and ages per root and overall."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.functions.messages import (
    dir_message,
    oldest_message,
    session_message,
    start_message,
    status_line,
    total_message,
    verdict_message,
)
from shelflife.functions.times import age_hours, as_of_literal, is_expired, micros_between, time_type
from shelflife.sources.tables import files_only


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("bigint"))


def dir_stats(inventory: DataFrame, as_of: dt.datetime, hours: int | Column) -> DataFrame:
    """One pass per root: files, bytes, files past retention, age of the oldest.

    All four are partial aggregates, so a root with most of the files sends one row per task.
    Entries that could not be read count as files and add nothing else.
    """
    now = as_of_literal(as_of, time_type(inventory))
    return (
        files_only(inventory)
        .groupBy("dir_name")
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            _zero(F.sum("size_bytes")).alias("total_size"),
            F.count_if(is_expired(F.col("mtime"), now, hours)).alias("violations"),
            age_hours(F.min("mtime"), now).alias("max_age_hours"),
        )
    )


def stats_for_roots(roots: DataFrame, stats: DataFrame) -> DataFrame:
    """Every asked-for root; one without files, or missing, has zeros and no age."""
    return roots.join(stats, "dir_name", "left").withColumns(
        {name: _zero(F.col(name)) for name in ("file_count", "total_size", "violations")}
    )


def status_report(stats: DataFrame) -> DataFrame:
    """The status line of each root."""
    line = status_line(
        F.col("dir_name"), F.col("total_size"), F.col("file_count"), F.col("violations")
    )
    return stats.select("dir_name", line.alias("line"))


def status_summary(stats: DataFrame, hours: int) -> DataFrame:
    """Totals over the roots, oldest age, and the verdict; one row, also without any root."""
    total = stats.agg(
        _zero(F.sum("file_count")).alias("file_count"),
        _zero(F.sum("total_size")).alias("total_size"),
        _zero(F.sum("violations")).alias("violations"),
        F.max("max_age_hours").alias("max_age_hours"),
    )
    return total.withColumns(
        {
            "retention_hours": F.lit(hours),
            "oldest": oldest_message(F.col("max_age_hours")),
            "verdict": verdict_message(F.col("violations"), F.lit(hours)),
        }
    )


def purge_summary(plan: DataFrame, dry_run: bool | Column) -> DataFrame:
    """Files and bytes per root of a plan or of an outcome; files that stayed do not count."""
    flag = dry_run if isinstance(dry_run, Column) else F.lit(dry_run)
    counted = plan.where(F.col("deleted")) if "deleted" in plan.columns else plan
    sums = counted.groupBy("dir_name").agg(
        F.count(F.lit(1)).alias("files"), _zero(F.sum("size_bytes")).alias("bytes")
    )
    return sums.withColumn(
        "message", dir_message(F.col("dir_name"), F.col("files"), F.col("bytes"), flag)
    )


def purge_rollup(summary: DataFrame) -> DataFrame:
    """Rows per root and the grand total, rolled up from the per-root rows and not from the files."""
    return summary.rollup("dir_name").agg(
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        (F.grouping("dir_name") == 1).alias("is_total"),
    )


def purge_total(
    summary: DataFrame, hours: int | Column, dry_run: bool | Column, tag: str | None = None
) -> DataFrame:
    """The run's one result row with its texts; zeros when nothing was expired."""
    flag = dry_run if isinstance(dry_run, Column) else F.lit(dry_run)
    window = hours if isinstance(hours, Column) else F.lit(int(hours))
    total = summary.agg(
        _zero(F.sum("files")).alias("files"), _zero(F.sum("bytes")).alias("bytes")
    )
    tagged = {} if tag is None else {"tag": tag}
    return total.withColumns(
        {
            "retention_hours": window,
            "start": start_message(window, flag),
            "message": total_message(F.col("files"), window),
            "session_message": session_message(F.col("files"), F.col("bytes"), flag, **tagged),
        }
    )


def retention_curve(inventory: DataFrame, as_of: dt.datetime, step_hours: int = 1) -> DataFrame:
    """Per root and window (dir_name, hours, files, bytes) what a purge with that window would free.

    There is a row for each window of whole steps, from 0 up, at which the curve falls: any other window frees what the
    next larger one in the list does. One pass over the inventory makes a histogram by age; the running sum goes over
    its rows. Files of unknown time, and of times to come, are freed by none.
    """
    step = step_hours * 3_600_000_000
    age = micros_between(F.col("mtime"), as_of_literal(as_of, time_type(inventory)))
    # The largest window that frees a file: it has to be older than the window, not as old.
    largest = (F.floor((age - 1) / F.lit(step)) * step_hours).cast("bigint")
    counted = files_only(inventory).where(age > 0).groupBy("dir_name", largest.alias("hours")).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )
    older = Window.partitionBy("dir_name").orderBy(F.desc("hours")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.select("dir_name", "hours", F.sum("files").over(older).alias("files"), F.sum("bytes").over(older).alias("bytes"))
