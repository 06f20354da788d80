"""Sizes and ages as text, as codegen-friendly column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit steps and names of the size format.
STEP = 1024
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def one_decimal(value: Column) -> Column:
    """A double with one decimal, correctly rounded from its binary value, ties to even.

    ``format_number`` with a pattern rounds this way; ``format_string('%.1f')`` rounds half up.
    """
    return F.call_function("format_number", value, F.lit("0.0"))


def format_size(size: Column) -> Column:
    """Bytes as text: whole bytes below one step, then one decimal; the last unit is open-ended."""
    number = size.cast("double")
    magnitude = F.abs(number)
    scaled, unit = number / float(STEP ** (len(UNITS) - 1)), F.lit(UNITS[-1])
    for power in range(len(UNITS) - 2, 0, -1):
        below = magnitude < float(STEP ** (power + 1))
        scaled = F.when(below, number / float(STEP**power)).otherwise(scaled)
        unit = F.when(below, F.lit(UNITS[power])).otherwise(unit)
    return F.when(
        magnitude < float(STEP), F.concat(size.cast("string"), F.lit(f" {UNITS[0]}"))
    ).otherwise(F.concat(one_decimal(scaled), F.lit(" "), unit))
