"""Scan of roots for secrets."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shelflife.operators.detect import (
    BUILTIN_DETECTORS,
    BatchDetector,
    Detector,
    find_again,
    find_in_files,
    merge_shared,
    number_positions,
    recommend,
    summarize,
)
from shelflife.session import bound_run_dir, write_once
from shelflife.sources.content import SPLIT_BYTES, file_content, ranges_content
from shelflife.sources.tree import existing_roots, rooted, walk_inventory


#: Text of a file that is searched again as one.
RANGE_BYTES = 64 * 1024 * 1024
#: How much more of a file a round searches again than the one before.
GROWTH = 8
SEARCH = ["dir_name", "item", "detector"]


class Scan(NamedTuple):
    findings: DataFrame
    summary: DataFrame
    advice: DataFrame
    #: Files, or parts of files, that could not be read: the findings do not cover them.
    unread: DataFrame
    run_dir: str


def _settled(found: DataFrame, inventory: DataFrame, detectors: Sequence[Detector], split_bytes: int, run_dir: str, secret: Column) -> DataFrame:
    """Findings of parts as one search through the whole file makes them.

    A search of a part starts some way before it, so matches that touch each other may lead it to the part's start
    in another step than the search of the part before left it. From an equal state both find the same. So the states
    on both sides of each boundary are compared, and where they differ the part is searched again from where the
    part before was left. In each round a file's first difference is mended, and others further on; what is searched
    again as one grows from round to round, up to ``RANGE_BYTES``, so a difference that goes on through the whole
    file costs few rounds. States away from the ends of a part are the only ones that are written.

    All joins sort and merge: files and ranges grow with the input, and paths are so much smaller in a written stage
    than in memory that its size on disk would have them broadcast through the driver.
    """
    span = max(d.span for d in detectors)
    states = found.where("category is not null and secret is null").select(*SEARCH, "part", "entry", "exit")
    rounds, units, width = [], None, 1
    while True:
        base, zero = f"{run_dir}/settle/{len(rounds)}", F.lit(0)
        ends = states.select(*SEARCH, F.col("part").alias("boundary"), "entry", zero.alias("left")).union(
            states.select(*SEARCH, F.col("part") + 1, zero, "exit")
        )
        differ = ends.groupBy(*SEARCH, "boundary").agg(F.max("entry").alias("entry"), F.max("left").alias("skip")).where("entry <> skip")
        before = F.lag("boundary").over(Window.partitionBy(*SEARCH).orderBy("boundary"))
        apart = differ.withColumn("before", before).where(F.coalesce(F.col("boundary") - F.col("before") >= width, F.lit(True)))
        chosen = apart.select(*SEARCH, F.col("boundary").alias("part"), "skip")
        if units is None:
            sized = chosen.withColumn("parts", F.lit(width))
        else:
            # Several parts searched as one stay one, and others end before them.
            other = units.where("parts > 1").select(*SEARCH, F.col("part").alias("start"), F.col("parts").alias("long")).distinct()
            ahead = chosen.join(other.hint("merge"), SEARCH, "left").groupBy(*chosen.columns).agg(
                F.max(F.when(F.col("start") == F.col("part"), F.col("long"))).alias("same"),
                F.min(F.when(F.col("start") > F.col("part"), F.col("start") - F.col("part"))).alias("room"),
            )
            sized = ahead.withColumn("parts", F.coalesce("same", F.least(F.lit(width), "room")).cast("int")).drop("same", "room")
        raw = inventory.select("dir_name", F.col("path").alias("item"), F.col("raw") if "raw" in inventory.columns else F.lit(None).cast("binary").alias("raw"))
        unit = write_once(sized.join(raw.hint("merge"), ["dir_name", "item"]), f"{base}/ranges")
        if unit.isEmpty():
            break
        again = write_once(
            find_again(ranges_content(unit, split_bytes, span), detectors).withColumn("secret", secret), f"{base}/found"
        )
        rounds.append(again)
        unit = unit.withColumn("round", F.lit(len(rounds)))
        units = unit if units is None else units.union(unit)
        covered = unit.select(*SEARCH, F.explode(F.sequence("part", F.col("part") + F.col("parts") - 1)).alias("part"))
        left = again.where("secret is null and category is not null and exit > 0")
        states = write_once(
            states.join(covered.hint("merge"), [*SEARCH, "part"], "left_anti")
            .union(unit.select(*SEARCH, "part", F.col("skip"), zero))
            .union(left.select(*SEARCH, F.col("part") + F.col("parts") - 1, zero, "exit")),
            f"{base}/states",
        )
        width = max(1, min(GROWTH * width, RANGE_BYTES // split_bytes))
    if not rounds:
        return found
    last = units.select(*SEARCH, F.explode(F.sequence("part", F.col("part") + F.col("parts") - 1)).alias("part"), "round")
    last = last.groupBy(*SEARCH, "part").agg(F.max("round").alias("last"))
    every = found.withColumn("round", F.lit(0))
    for k, again in enumerate(rounds, 1):
        every = every.union(again.select(*found.columns, F.lit(k)))
    return every.join(last.hint("merge"), [*SEARCH, "part"], "left").where(F.col("round") == F.coalesce("last", F.lit(0))).select(found.columns)


def scan_files(
    inventory: DataFrame,
    roots: DataFrame,
    run_dir: str,
    extra: Sequence[Detector | BatchDetector] = (),
    builtin: Sequence[Detector] = BUILTIN_DETECTORS,
    split_bytes: int | None = SPLIT_BYTES,
    digest: bool = False,
) -> Scan:
    """Findings, counts and advice. What is found is written once, so the text is read once.

    Detectors with a span read files in parts; those without one, and batch detectors, read every file as one
    text. Which way a detector goes depends on the detector and never on the size of a file. The findings are
    rebalanced before the write, since most tasks of a large scan find little or nothing. ``digest`` keeps the
    SHA-256 of each secret in the secret's place.
    """
    detectors = [*builtin, *extra]
    in_parts = [d for d in detectors if isinstance(d, Detector) and d.span is not None and split_bytes is not None]
    whole = [d for d in detectors if d not in in_parts]
    found = []
    if in_parts:
        found.append(find_in_files(file_content(inventory, split_bytes, max(d.span for d in in_parts)), in_parts))
    if whole:
        found.append(find_in_files(file_content(inventory, None), whole, len(in_parts)))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    secret = F.when(F.col("category").isNull(), F.col("secret")).otherwise(F.sha2("secret", 256)) if digest else F.col("secret")
    rows = write_once(rows.withColumn("secret", secret).hint("rebalance"), f"{run_dir}/found")
    if in_parts:
        rows = _settled(rows, inventory, in_parts, split_bytes, run_dir, secret)
    unread = rows.where("category is null").select("dir_name", "item", F.col("secret").alias("error")).distinct()
    findings = merge_shared(number_positions(rows.where("category is not null and secret is not null").drop("entry", "exit")), detectors)
    findings = write_once(findings.select("dir_name", "item", "category", "position", "secret"), f"{run_dir}/findings")
    return Scan(findings, summarize(findings), recommend(roots.select("dir_name"), findings), unread, run_dir)


def scan_trees(
    spark: SparkSession,
    roots: dict[str, str],
    extra: Sequence[Detector | BatchDetector] = (),
    run_dir: str | None = None,
    split_bytes: int | None = SPLIT_BYTES,
    digest: bool = False,
) -> Scan:
    """Scan every file below the roots.

    The findings, secrets included unless ``digest``, stay below the scan's ``run_dir`` until the caller
    deletes it.
    """
    roots = rooted(roots)
    named = [repr(d) for d in extra]
    run_dir = bound_run_dir(spark, run_dir, "scan", roots=roots, extra=named, split_bytes=split_bytes, digest=digest)
    inventory = walk_inventory(spark, roots, f"{run_dir}/walk")
    return scan_files(inventory, existing_roots(spark, roots), run_dir, extra, split_bytes=split_bytes, digest=digest)
