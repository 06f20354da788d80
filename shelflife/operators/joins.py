"""Joins of many rows per root, or per key, with one row of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Parts a root is split into when the other side is too large to broadcast.
ROOT_PARTS = 16
# Keys whose row is broadcast in ``join_per_key``, at most.
HOT_KEYS = 1024


def _estimated_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _broadcast_limit(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def join_root_rows(rows: DataFrame, per_root: DataFrame, how: str, spread_by: str = "path") -> DataFrame:
    """Join ``rows`` with ``per_root``, which has one row per ``dir_name``.

    While the estimated size of ``per_root`` is below the broadcast threshold Catalyst broadcasts it and the
    rows do not move. Beyond it each root is split by a hash of ``spread_by`` and its one row repeated per
    part, so a root with most of the rows is sorted by several tasks; AQE may split a part further, since
    what follows never relies on the join's partitioning by root.
    """
    if _estimated_bytes(per_root) <= _broadcast_limit(rows.sparkSession):
        return rows.join(per_root, "dir_name", how)
    parts = F.sequence(F.lit(0).cast("bigint"), F.lit(ROOT_PARTS - 1).cast("bigint"))
    split = rows.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(ROOT_PARTS).cast("bigint")))
    repeated = per_root.withColumn("_part", F.explode(parts))
    return split.join(repeated, ["dir_name", "_part"], how).drop("_part")


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row per key and in ``count`` how many rows the key has.

    A key with more than one in ``HOT_KEYS`` of all rows would fill a task of its own. There are fewer than
    ``HOT_KEYS`` of them, so their rows are broadcast and the rows of ``rows`` stay where they are; the others meet by
    their key. Rows whose key has no row in ``per_key`` are left out.
    """
    names = [c for c in per_key.columns if c not in (key, count)]
    total = per_key.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).scalar()
    hot = per_key.where(F.col(count) * HOT_KEYS > total)
    found = rows.join(F.broadcast(hot.select(key, F.struct(*names).alias("_hot"))), key, "left")
    there = found.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{n}").alias(n) for n in names))
    others = found.where("_hot is null").select(*rows.columns)
    return there.union(others.join(per_key.select(key, *names), key).select(*rows.columns, *names))
