"""Purge of a parquet table file by file, decided by what the files' footers say."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelflife.operators.purge import MARK
from shelflife.operators.retention import retained_rows
from shelflife.session import drop_folder, folder_exists, is_written, local_name, mounted_path, write_once

STAGING = "_shelflife_purge_files"
RANGES = "file string, rows long, low long, high long, nulls long, known boolean"
OUTCOME = "file string, action string, rows long, kept long"


def _mark(uri: Column) -> Column:
    """A short name for a file given by its URI, however many slashes the URI begins with."""
    return F.concat(F.lit("f"), F.md5(F.regexp_replace(uri, "^([a-z]+):/+", "$1:/").cast("binary")))


def _footers(time: str):
    """Rows, least and largest time in microseconds, and rows without one, of each file."""

    def range_of(uri):
        import pyarrow.parquet as pq

        with pq.ParquetFile(mounted_path(uri)) as file:
            found, schema = file.metadata, file.schema_arrow
        rows = found.num_rows
        if time not in schema.names:
            return rows, None, None, rows, True
        unit = {"s": 1e6, "ms": 1e3, "us": 1, "ns": 1e-3}.get(getattr(schema.field(time).type, "unit", None))
        lows, highs, nulls, known = [], [], 0, unit is not None
        for k in range(found.num_row_groups):
            group = found.row_group(k)
            column = next(c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == time)
            stats = column.statistics
            if column.physical_type != "INT64" or stats is None or not stats.has_null_count:
                return rows, None, None, None, False
            nulls += stats.null_count
            if stats.null_count < group.num_rows:
                if not stats.has_min_max:
                    return rows, None, None, None, False
                lows.append(stats.min_raw)
                highs.append(stats.max_raw)
        if not known or not lows:
            return rows, None, None, nulls, known or not lows
        # Fractions of a microsecond are rounded away from the range's inside.
        low, high = (min(lows) // 1000, -(-max(highs) // 1000)) if unit < 1 else (min(lows) * int(unit), max(highs) * int(unit))
        return rows, low, high, nulls, True

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(uri, *range_of(uri)) for uri in pdf["file"]]
            out = pd.DataFrame(rows, columns=["file", "rows", "low", "high", "nulls", "known"])
            yield out.astype({c: "Int64" for c in ("rows", "low", "high", "nulls")})

    return run


def file_ranges(spark: SparkSession, path: str, time: str) -> DataFrame:
    """Per data file of a parquet table its rows and the range of ``time``, read from the footer by tasks.

    A file without the column has no times. ``known`` is false where a footer does not tell, as with INT96 times. The
    table lies on a mount every executor sees; the driver holds its list of files, as Spark's reader does.
    """
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "file").mapInPandas(_footers(time), RANGES)


def file_actions(ranges: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    """What a purge does to each file: keep or drop it as it is, or look at its rows."""
    as_of = as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    bound = F.lit((as_of - dt.timedelta(hours=hours) - epoch) // dt.timedelta(microseconds=1))
    action = (
        F.when(~F.col("known"), "rewrite")
        .when(F.col("low").isNull() | (F.col("low") >= bound), "keep")
        .when((F.col("high") < bound) & (F.col("nulls") == 0), "drop")
        .otherwise("rewrite")
    )
    return ranges.select("file", "rows", action.alias("action"), _mark(F.col("file")).alias("mark"))


def _exchange(staging: str):
    """Move old files away and what was rewritten into their place. Every step may have been done before."""

    def move(source, target):
        import os

        try:
            os.rename(source, target)
        except FileNotFoundError:
            pass  # an earlier attempt has moved it

    def run(batches):
        import os

        for pdf in batches:
            for uri, action, mark in zip(pdf["file"], pdf["action"], pdf["mark"]):
                path, new = mounted_path(uri), f"{staging}/new/{MARK}={mark}"
                os.makedirs(f"{staging}/old", exist_ok=True)
                move(path, f"{staging}/old/{mark}")
                if action == "rewrite" and os.path.isdir(new):
                    for k, name in enumerate(sorted(n for n in os.listdir(new) if n.endswith(".parquet") and n[0] not in "._")):
                        # The staged name stays part of the new one, so a second attempt gives no other.
                        move(f"{new}/{name}", f"{os.path.dirname(path)}/{name.split('.')[0]}-{mark}.parquet")
            yield pdf[["file", "action", "rows", "kept"]]

    return run


def _finish(spark: SparkSession, staging: str) -> DataFrame:
    """Exchange the files of a manifest in tasks; returns files and rows per action."""
    manifest = spark.read.schema(f"{OUTCOME}, mark string").parquet(f"{staging}/manifest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = manifest.where("action <> 'keep'").repartition(tasks, "file").mapInPandas(_exchange(mounted_path(staging)), OUTCOME)
    done = write_once(moved, f"{staging}/moved").unionByName(manifest.where("action = 'keep'").select("file", "action", "rows", "kept"))
    found = done.groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("kept").alias("kept"))
    out = spark.createDataFrame(found.collect(), found.schema)
    drop_folder(spark, staging)
    return out


def purge_by_footers(spark: SparkSession, path: str, as_of: dt.datetime, hours: int, time: str) -> DataFrame:
    """Delete the expired rows of a parquet table; returns files and rows per action (keep, drop, rewrite).

    Files whose range of times lies on one side of the cutoff are kept or dropped without reading a row; only those on
    both sides, or of unknown range, are read, and the rows that stay are written beside the table in one job, with all
    columns any of these files has. One that turns out to lose nothing is kept, one that loses all is dropped. Then a
    manifest is written, and from there on tasks move files only, each its own, and the last of it is committed as a
    table: a purge interrupted before the manifest has changed nothing, the next call finishes one interrupted after
    it, whatever its arguments, and then does its own work. A reader may miss a file while it is exchanged, and no
    other job may write to the table meanwhile. The driver holds the names of files that are read.
    """
    path = path.rstrip("/")
    staging = f"{path}/{STAGING}"
    if is_written(spark, f"{staging}/manifest"):
        _finish(spark, staging)
    elif folder_exists(spark, staging):
        drop_folder(spark, staging)
    plan = write_once(file_actions(file_ranges(spark, path, time), as_of, hours), f"{staging}/plan")
    read = [r["file"] for r in plan.where("action = 'rewrite'").select("file").collect()]
    if read:
        old = spark.read.option("mergeSchema", "true").parquet(*(local_name(spark, f) for f in read))
        retained_rows(old.select("*", _mark(F.col("_metadata.file_path")).alias(MARK)), as_of, hours, time).write.partitionBy(MARK).parquet(f"{staging}/new")
        kept = spark.read.parquet(f"{staging}/new").groupBy(F.col(MARK).alias("mark")).agg(F.count(F.lit(1)).alias("left"))
        strange = kept.join(plan, "mark", "left").where("coalesce(left > rows or action <> 'rewrite', true)")
        if not strange.isEmpty():
            drop_folder(spark, staging)
            raise RuntimeError(f"{path} changed while it was purged; nothing was deleted")
    else:
        kept = spark.createDataFrame([], "mark string, left long")
    left = F.coalesce("left", F.lit(0))
    action = F.when(F.col("action") != "rewrite", F.col("action")).when(left == F.col("rows"), "keep").when(left == 0, "drop").otherwise("rewrite")
    stays = F.when(action == "keep", F.col("rows")).when(action == "drop", F.lit(0)).otherwise(left)
    manifest = plan.join(kept, "mark", "left").select("file", action.alias("action"), "rows", stays.cast("long").alias("kept"), "mark")
    write_once(manifest, f"{staging}/manifest")
    return _finish(spark, staging)
