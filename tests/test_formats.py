from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelflife.functions.formats import format_size, one_decimal

EXPECTED = {
    0: "0 B",
    100: "100 B",
    1023: "1023 B",
    1024: "1.0 KB",
    1280: "1.2 KB",
    1536: "1.5 KB",
    1792: "1.8 KB",
    10240: "10.0 KB",
    1048575: "1024.0 KB",
    1048576: "1.0 MB",
    5242880: "5.0 MB",
    1073741824: "1.0 GB",
    2**40: "1.0 TB",
    2**50: "1.0 PB",
    2**62: "4096.0 PB",
    -1: "-1 B",
    -1280: "-1.2 KB",
}


def sizes(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "size bigint")
    return {r[0]: r[1] for r in df.select("size", format_size(F.col("size"))).collect()}


def test_fixed_sizes(spark):
    assert sizes(spark, EXPECTED) == EXPECTED


def rule(size):
    """The rule in words: divide by 1024 until below 1024, one decimal, correctly rounded."""
    if abs(size) < 1024:
        return f"{size} B"
    power = next((p for p in (1, 2, 3, 4) if abs(size) < 1024 ** (p + 1)), 5)
    return f"{size / 1024**power:.1f} {'KB MB GB TB PB'.split()[power - 1]}"


def test_random_and_tie_sizes(spark):
    rng = random.Random(7)
    values = [rng.randrange(1 << rng.randrange(1, 63)) * rng.choice((1, -1)) for _ in range(20000)]
    values += [128 * n for n in range(8000)] + [131072 * n for n in range(8000)]
    found = sizes(spark, values)
    assert {v: t for v, t in found.items() if t != rule(v)} == {}


def test_one_decimal_rounds_like_the_binary_value(spark):
    rng = random.Random(8)
    values = [n / 20 for n in range(-2000, 20000)]
    values += [rng.uniform(-1e5, 1e5) for _ in range(20000)] + [rng.uniform(-1, 1) for _ in range(5000)]
    values += [rng.randrange(10**15) / 3.6e9 for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wrong = [r for r in df.select("x", one_decimal(F.col("x"))).collect() if r[1] != f"{r[0]:.1f}"]
    assert wrong == []


@pytest.mark.parametrize("value", [None])
def test_null(spark, value):
    row = spark.createDataFrame([(value,)], "size bigint").select(format_size(F.col("size"))).first()
    assert row[0] is None
