"""Sinks that delete: files, emptied directories, and rows of a partitioned table."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.functions.times import as_of_literal, cutoff, is_expired, time_type
from shelflife.operators.retention import retained_rows
from shelflife.session import drop_folder, folder_exists, is_written, local_name, move_folder, write_once

FILES_PER_STAGED_FILE = 20_000
FILE_OUTCOME = "dir_name string, path string, size_bytes bigint, deleted boolean, error string"
MANIFEST = "folder string, mark string, action string"
# Columns a purge adds: the folder a row is in, and a short name for it.
FOLDER, MARK = "__folder", "__mark"
DIR_OUTCOME = "dir_name string, path string, depth int, removed boolean"


def _may_have_run(spark: SparkSession, marker: str) -> bool:
    """Whether some of a step's work may be done already, or be done at the same time by a second copy.

    True when an earlier run entered the step, which ``marker`` records, or when tasks are speculative.
    """
    speculative = spark.sparkContext.getConf().get("spark.speculation", "false") == "true"
    entered = is_written(spark, marker)
    if not entered:
        spark.range(0).write.mode("overwrite").parquet(marker)
    return entered or speculative


def _unlink(roots: dict[str, str], may_have_run: bool):
    """Delete each file unless it left its root or changed since it was listed.

    A file that is already gone counts as deleted only if another attempt of the same work may have
    deleted it.
    """
    known = dict(roots)

    def run(batches):
        import os
        from functools import lru_cache

        from pyspark import TaskContext

        again = may_have_run or TaskContext.get().attemptNumber() > 0
        bases = {name: os.path.realpath(base) + os.sep for name, base in known.items()}

        @lru_cache(maxsize=10_000)
        def inside(folder, base):
            return base is not None and (os.path.realpath(folder) + os.sep).startswith(base)

        def attempt(dir_name, path, raw, micros):
            path = path if raw is None else raw
            if not inside(os.fsdecode(os.path.dirname(path)), bases.get(dir_name)):
                return False, "outside its root"
            try:
                if os.stat(path).st_mtime_ns // 1000 != micros:
                    return False, "changed since listed"
                os.unlink(path)
            except FileNotFoundError:
                return (True, None) if again else (False, "already gone")
            except OSError as problem:
                return False, type(problem).__name__
            return True, None

        for pdf in batches:
            done = [attempt(*row) for row in zip(pdf["dir_name"], pdf["path"], pdf["raw"], pdf["micros"])]
            out = pdf[["dir_name", "path", "size_bytes"]].copy()
            out["deleted"] = [ok for ok, _ in done]
            out["error"] = [problem for _, problem in done]
            yield out

    return run


def purge_files(plan: DataFrame, roots: dict[str, str], run_dir: str) -> DataFrame:
    """Delete the files of a plan, once, and return the outcome per file.

    The plan is written first, so what is deleted never depends on listing again, and in files of bounded
    row count, so that reading it back spreads the work evenly. The deleting stage reads that table and
    writes the outcome without a shuffle: a lost executor repeats only its own uncommitted tasks, as
    further attempts. Calling again with the same ``run_dir`` finishes an interrupted run, and after a
    finished one only returns its outcome.
    """
    spark = plan.sparkSession
    raw = F.col("raw") if "raw" in plan.columns else F.lit(None).cast("binary").alias("raw")
    staged = write_once(
        plan.select("dir_name", "path", raw, "size_bytes", F.unix_micros("mtime").alias("micros")),
        f"{run_dir}/plan",
        maxRecordsPerFile=FILES_PER_STAGED_FILE,
    )
    may_have_run = _may_have_run(spark, f"{run_dir}/deleting")
    return write_once(staged.mapInPandas(_unlink(roots, may_have_run), FILE_OUTCOME), f"{run_dir}/outcome")


def _remove_folders(may_have_run: bool):
    def run(batches):
        import os

        from pyspark import TaskContext

        def attempt(path):
            try:
                os.rmdir(path)
            except FileNotFoundError:
                return again
            except OSError:
                return False
            return True

        again = may_have_run or TaskContext.get().attemptNumber() > 0
        for pdf in batches:
            yield pdf.assign(removed=[attempt(path) for path in pdf["path"]])

    return run


def remove_folders(plan: DataFrame, run_dir: str) -> DataFrame:
    """Remove the directories of a prune plan, deepest level first, each level in parallel.

    Only an empty directory can be removed, so one that received a file meanwhile stays.
    """
    spark = plan.sparkSession
    staged = write_once(
        plan.select("dir_name", "path", "depth"),
        f"{run_dir}/prune",
        partition_by=("depth",),
        maxRecordsPerFile=FILES_PER_STAGED_FILE,
    )
    may_have_run = _may_have_run(spark, f"{run_dir}/pruning")
    deepest = staged.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        level = staged.where(F.col("depth") == depth)
        removed = level.mapInPandas(_remove_folders(may_have_run), DIR_OUTCOME)
        write_once(removed, f"{run_dir}/removed/level={depth}")
    if deepest == 0:
        return spark.createDataFrame([], DIR_OUTCOME)
    return spark.read.schema(DIR_OUTCOME).parquet(f"{run_dir}/removed").drop("level")


def partition_actions(
    table: DataFrame,
    partition: str | list[str],
    as_of: dt.datetime,
    hours: int,
    time: str,
    dated: bool | str = False,
) -> DataFrame:
    """What a purge does to each partition: drop it, rewrite it, or keep it untouched.

    ``dated`` says that the partition column, or the column it names, is the date of the time column;
    partitions newer than the cutoff are then not even listed.
    """
    now = as_of_literal(as_of, time_type(table, time))
    if dated:
        day = dated if isinstance(dated, str) else partition
        table = table.where(F.col(day) <= F.to_date(cutoff(now, hours)))
    return (
        table.groupBy(partition)
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_expired(F.col(time), now, hours)).alias("expired"))
        .withColumn(
            "action",
            F.when(F.col("expired") == 0, "keep")
            .when(F.col("expired") == F.col("rows"), "drop")
            .otherwise("rewrite"),
        )
    )


PURGE_FOLDER = "_shelflife_purge"


def _finish_purge(spark: SparkSession, staging: str) -> None:
    """Put the staged folders of a manifest in place. Every step may have been done before."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{staging}/manifest")
    for row in manifest.collect():
        new, old = f"{staging}/new/{MARK}={row['mark']}", f"{staging}/old/{row['mark']}"
        waiting = row["action"] == "rewrite" and folder_exists(spark, new)
        if (waiting or row["action"] == "drop") and not folder_exists(spark, old):
            move_folder(spark, row["folder"], old)
        if waiting:
            move_folder(spark, new, row["folder"])
    drop_folder(spark, staging)


def purge_table(
    spark: SparkSession,
    path: str,
    partition: str,
    as_of: dt.datetime,
    hours: int,
    time: str,
    dated: bool = False,
) -> DataFrame:
    """Delete the expired rows of a partitioned parquet table; returns the actions per value of ``partition``.

    The table may have further partition columns; what is dropped or rewritten are its innermost folders,
    under the names they have. Partly expired folders are rewritten in one job beside the table, with all
    columns any of them has; columns whose types do not go together fail the purge before it changes
    anything. The rewritten rows are counted against what must stay. Then a manifest is written, and from
    there on the purge only moves folders: the old one away, the new one into its place. Wholly expired
    folders are only moved away, the others are not touched.

    A purge interrupted before the manifest has changed nothing; the next call finishes one interrupted
    after it, whatever its arguments, and then does its own work. The driver holds one row per touched
    folder and moves them; a reader may miss a folder while it is exchanged. No other job may write to the
    touched folders meanwhile. :func:`partition_actions` is the dry run.
    """
    path = path.rstrip("/")
    staging = f"{path}/{PURGE_FOLDER}"
    if is_written(spark, f"{staging}/manifest"):
        _finish_purge(spark, staging)
    elif folder_exists(spark, staging):
        drop_folder(spark, staging)
    table = spark.read.option("mergeSchema", "true").parquet(path)
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)
    rows = table.select("*", folder.alias(FOLDER))
    by_folder = partition_actions(rows, [partition, FOLDER], as_of, hours, time, dated and partition).where("action <> 'keep'")
    touched = [(r[FOLDER], r["action"], r["rows"] - r["expired"]) for r in by_folder.collect()]
    actions = partition_actions(table, partition, as_of, hours, time, dated).where("action <> 'keep'")
    taken = spark.createDataFrame(actions.collect(), actions.schema) if touched else spark.createDataFrame([], actions.schema)
    if not touched:
        return taken
    if any(f"/{partition}=" not in uri for uri, _, _ in touched):
        raise ValueError(f"{partition} is no partition column of {path}")
    marks = {uri: "f" + hashlib.md5(uri.encode()).hexdigest() for uri, _, _ in touched}
    kept = {marks[uri]: n for uri, action, n in touched if action == "rewrite"}
    if kept:
        folders = [local_name(spark, uri) for uri, action, _ in touched if action == "rewrite"]
        old = spark.read.option("mergeSchema", "true").parquet(*folders)
        mark = F.concat(F.lit("f"), F.md5(folder.cast("binary")))
        staying = retained_rows(old.select("*", mark.alias(MARK)), as_of, hours, time)
        staying.write.partitionBy(MARK).parquet(f"{staging}/new")
        found = spark.read.parquet(f"{staging}/new").groupBy(MARK).agg(F.count(F.lit(1)).alias("n"))
        written = {r[MARK]: r["n"] for r in found.collect()}
        if written != kept:
            drop_folder(spark, staging)
            raise RuntimeError(f"{path} changed while it was purged; nothing was deleted")
    plan = [(uri, marks[uri], action) for uri, action, _ in touched]
    spark.createDataFrame(plan, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{staging}/manifest")
    _finish_purge(spark, staging)
    return taken
