"""Any table as an inventory, and several roots as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def table_inventory(
    table: DataFrame,
    dir_name: Column | str,
    path: Column | str,
    size_bytes: Column | str,
    mtime: Column | str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Map a table's columns to the inventory; ``keep`` carries further columns, e.g. a partition date."""
    return table.select(
        _column(dir_name).alias("dir_name"),
        _column(path).alias("path"),
        _column(size_bytes).cast("bigint").alias("size_bytes"),
        _column(mtime).alias("mtime"),
        F.lit(False).alias("is_dir"),
        F.lit(True).alias("stat_ok"),
        *[F.col(name) for name in keep or []],
    )


def table_content(
    table: DataFrame, dir_name: Column | str, item: Column | str, text: str, keep: list[str] | None = None
) -> DataFrame:
    """Map a table to content to be scanned: one whole text per item; ``keep`` carries further columns."""
    return table.select(
        _column(dir_name).cast("string").alias("dir_name"),
        _column(item).cast("string").alias("item"),
        F.col(text).alias("text"),
        *[F.col(name) for name in keep or []],
    )


def union_roots(roots: dict[str, DataFrame]) -> DataFrame:
    """One frame over several roots, each row tagged with the name of its root."""
    tagged = [df.withColumn("dir_name", F.lit(name)) for name, df in roots.items()]
    return reduce(DataFrame.unionByName, tagged)


def files_only(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.col("is_dir"))
