"""Policies narrower than a root: of nested folders, and of periods of time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.functions.times import as_of_literal, cutoff, micros_between, time_type
from shelflife.operators.joins import join_per_key
from shelflife.operators.policy import DEFAULTS, TYPES
from shelflife.sources.tables import files_only

#: Periods in which the versions of a root are looked up together.
PERIOD = dt.timedelta(days=7)


def _folder(path: Column) -> Column:
    """The folder a path lies in, empty for a path without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def folder_policies(folders: DataFrame, scopes: DataFrame, defaults: dict | None = None) -> DataFrame:
    """The settings of every ``folder``: each is that of the innermost scope around it that says something.

    ``scopes`` has one row per ``scope``, a folder's path, and any of the settings; NULL means "not set", so an outer
    scope's value goes on. Whole names are compared: ``logs/a`` is no scope of ``logs/ab``. A setting no scope names
    has its default. Folders are expanded to those above them as far down as scopes reach; a scope that holds most
    folders, such as a root, does not meet them in one task.
    """
    given = scopes.withColumn("scope", F.regexp_replace("scope", "/+$", "")).where("scope is not null")
    names = [n for n in DEFAULTS if n in given.columns]
    # Two rows of one scope: the larger value of each setting.
    given = given.groupBy("scope").agg(*(F.max(F.col(n).cast(TYPES[n])).alias(n) for n in names))
    deepest = given.agg(F.coalesce(F.max(F.size(F.split("scope", "/"))), F.lit(0)).alias("n")).scalar()
    parts = F.split("folder", "/")
    lengths = F.sequence(F.lit(1), F.least(F.size(parts), F.col("_deepest")))
    above = F.transform(lengths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("scope")))
    spread = folders.select("folder").distinct().withColumn("_deepest", deepest).where("_deepest > 0").select("folder", F.inline(above))
    counted = spread.groupBy("scope").agg(F.count(F.lit(1)).alias("_rows")).join(given, "scope")
    found = join_per_key(spread, counted, "scope", "_rows")
    inner = found.groupBy("folder").agg(
        *(F.max(F.when(F.col(n).isNotNull(), F.struct("depth", n)))[n].alias(n) for n in names)
    )
    filled = {**DEFAULTS, **(defaults or {})}
    known = folders.select("folder").distinct().join(inner, "folder", "left")
    return known.select(
        "folder", *(F.coalesce(*([F.col(n)] if n in names else []), F.lit(v).cast(TYPES[n])).alias(n) for n, v in filled.items())
    )


def with_folder_policy(inventory: DataFrame, scopes: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Every file with the settings of the folder it lies in. Policies are looked up once per folder, not per file."""
    files = files_only(inventory).withColumn("folder", _folder(F.col("path")))
    per_folder = files.groupBy("folder").agg(F.count(F.lit(1)).alias("_rows"))
    settings = folder_policies(per_folder, scopes, defaults)
    return join_per_key(files, per_folder.join(settings, "folder"), "folder", "_rows").drop("folder")


def expired_by_folder(inventory: DataFrame, scopes: DataFrame, as_of: dt.datetime, defaults: dict | None = None) -> DataFrame:
    """Files older than the window of the innermost scope they lie in."""
    now = as_of_literal(as_of, time_type(inventory))
    return with_folder_policy(inventory, scopes, defaults).where(F.col("mtime") < cutoff(now, F.col("retention_hours")))


def with_dated_policy(files: DataFrame, versions: DataFrame, default: int = DEFAULTS["retention_hours"], period: dt.timedelta = PERIOD) -> DataFrame:
    """Every file with the ``retention_hours`` in force in its root when the file was written.

    ``versions`` (dir_name, valid_from, retention_hours) are in force from their time on, up to the root's next. NULL
    hours mean "not set" and change nothing; of two versions of one time the longer window wins. Before a root's
    first version, and for files without a time, the default holds.

    Time is cut into periods. What is in force when a period of a root starts is found by union, order and last value
    over the root's versions and the periods its files lie in. With it and its own versions a period is complete,
    so files meet the versions of their root and period only. A period with a large share of all files is joined
    where its files are; the versions of one root in one period are one list.
    """
    kind = time_type(files)
    micros = lambda c, t: micros_between(as_of_literal(dt.datetime(1970, 1, 1), t), F.col(c))
    width = period // dt.timedelta(microseconds=1)
    of = lambda at: F.floor(at / F.lit(width)).cast("bigint")
    given = (
        versions.where("retention_hours is not null and valid_from is not null and dir_name is not null")
        .groupBy("dir_name", micros("valid_from", time_type(versions, "valid_from")).alias("at"))
        .agg(F.max("retention_hours").cast("int").alias("hours"))
    )
    placed = files.withColumn("_at", micros("mtime", kind)).withColumn("_period", F.struct("dir_name", of(F.col("_at")).alias("n")))
    periods = placed.where("_at is not null").groupBy("_period").agg(F.count(F.lit(1)).alias("_rows"))
    starts = periods.select("_period.dir_name", (F.col("_period.n") * width).alias("at"), F.lit(None).cast("int").alias("hours"), F.lit(0).alias("kind"))
    in_order = Window.partitionBy("dir_name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        starts.union(given.select("dir_name", "at", "hours", F.lit(1)))
        .withColumn("hours", F.last("hours", ignorenulls=True).over(in_order))
        .where("kind = 0 and hours is not null")
        .select("dir_name", "at", "hours")
    )
    # A version from a period's very start on comes after the one carried in.
    lists = (
        carried.withColumn("own", F.lit(0)).union(given.withColumn("own", F.lit(1)))
        .groupBy(F.struct("dir_name", of(F.col("at")).alias("n")).alias("_period"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "own", "hours"))).alias("_versions"))
    )
    per_period = periods.join(lists, "_period", "left")
    known = join_per_key(placed.where("_at is not null"), per_period, "_period", "_rows")
    so_far = F.filter("_versions", lambda v: v["at"] <= F.col("_at"))
    hours = F.coalesce(F.get(so_far, F.size(so_far) - 1)["hours"], F.lit(default))
    timeless = placed.where("_at is null").withColumn("retention_hours", F.lit(default))
    return known.withColumn("retention_hours", hours).select(*files.columns, "retention_hours").union(timeless.select(*files.columns, "retention_hours"))


def expired_by_dated_policy(inventory: DataFrame, versions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Files older than the window that was in force in their root when they were written."""
    now = as_of_literal(as_of, time_type(inventory))
    files = files_only(inventory).where(F.col("mtime").isNotNull())
    return with_dated_policy(files, versions).where(F.col("mtime") < cutoff(now, F.col("retention_hours")))
