"""Scan of what changed since the last scan."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.operators.detect import BUILTIN_DETECTORS, BatchDetector, Detector, recommend, summarize
from shelflife.plans.scan import scan_files
from shelflife.session import is_written, write_once
from shelflife.sources.content import SPLIT_BYTES
from shelflife.sources.tables import files_only
from shelflife.sources.tree import existing_roots, rooted, walk_inventory

#: What tells one state of a file from another.
STATE = ["dir_name", "path", "size_bytes", "mtime"]
FINDINGS = ["dir_name", "item", "category", "position", "secret"]
UNREAD = ["dir_name", "item", "error"]


class Rescan(NamedTuple):
    findings: DataFrame
    summary: DataFrame
    advice: DataFrame
    unread: DataFrame
    #: Files whose text was read.
    changed: DataFrame
    number: int


def catalogue_version(detectors: Sequence[Detector | BatchDetector], version: str = "") -> str:
    """A digest of all that decides what a text's findings are. What a batch detector does has to be told by ``version``."""
    return hashlib.sha256(repr((version, list(detectors))).encode()).hexdigest()


def _scans(spark: SparkSession, state_dir: str) -> int:
    """How many scans have been committed."""
    n = 0
    while is_written(spark, f"{state_dir}/scan-{n + 1}/done"):
        n += 1
    return n


def rescan_trees(
    spark: SparkSession,
    roots: dict[str, str],
    state_dir: str,
    extra: Sequence[Detector | BatchDetector] = (),
    builtin: Sequence[Detector] = BUILTIN_DETECTORS,
    split_bytes: int | None = SPLIT_BYTES,
    digest: bool = False,
    version: str = "",
) -> Rescan:
    """The findings of all files below the roots, reading only files that the last scan of ``state_dir`` did not read.

    A file is taken as unchanged if its path, size and time are those of the last scan and the detectors are the same,
    by their patterns and the caller's ``version``; its findings are carried over. Findings of files that are gone or
    have changed are dropped. Files the last scan could not read are tried again. Each scan has its folder below
    ``state_dir``; one that was interrupted is finished by the next call, over the files it had listed. Only paths and
    findings are joined, by path, so no root or file gathers in one task.
    """
    roots = rooted(roots)
    detectors = [*builtin, *extra]
    done = _scans(spark, state_dir)
    here, before = f"{state_dir}/scan-{done + 1}", f"{state_dir}/scan-{done}"
    catalogue = catalogue_version(detectors, f"{version}/{digest}")
    inventory = files_only(walk_inventory(spark, roots, f"{here}/walk"))
    same = done > 0 and spark.read.parquet(f"{before}/done").first()["catalogue"] == catalogue
    if same:
        known = spark.read.parquet(f"{before}/walk/inventory").where(~F.col("is_dir") & F.col("stat_ok"))
        unread = spark.read.parquet(f"{before}/unread").select("dir_name", F.col("item").alias("path")).distinct()
        known = known.select(STATE).join(unread, ["dir_name", "path"], "left_anti")
        changed = inventory.join(known, STATE, "left_anti")
        unchanged = inventory.select(STATE).join(known, STATE, "left_semi").select("dir_name", F.col("path").alias("item"))
        carried = spark.read.parquet(f"{before}/findings").join(unchanged, ["dir_name", "item"], "left_semi")
    else:
        changed, carried = inventory, None
    changed = write_once(changed.select(inventory.columns), f"{here}/changed")
    there = existing_roots(spark, roots)
    new = scan_files(changed, there, f"{here}/new", extra, builtin, split_bytes, digest)
    findings = new.findings.select(FINDINGS) if carried is None else carried.select(FINDINGS).unionByName(new.findings.select(FINDINGS))
    findings = write_once(findings, f"{here}/findings")
    unread = write_once(new.unread.select(UNREAD), f"{here}/unread")
    write_once(spark.createDataFrame([(catalogue,)], "catalogue string").coalesce(1), f"{here}/done")
    return Rescan(findings, summarize(findings), recommend(there.select("dir_name"), findings), unread, changed, done + 1)
