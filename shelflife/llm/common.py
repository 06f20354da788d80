"""What the operators share: tables, words, written stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelflife.session import shared_dir

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder, read back without lineage."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int) -> Column:
    """True for documents kept out of training: crc32 of the id as text leaves remainder 2. Null ids never are."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


#: Entries collected before they are put away, and code points of a piece of text.
BLOCK, CHUNK = 256, 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collect_over(items: Column, start: dict[str, Column], walk: Callable, kind: str, finish: Callable | None = None) -> Column:
    """Walk an array with a state, collecting entries of type ``kind`` in the state's array ``out``.

    ``walk`` gets the state and an item and returns the state; ``finish`` makes the result of the last state, whose
    ``out`` holds all entries. Appending to an array copies it, so entries are collected in blocks, which keeps
    long arrays linear.
    """
    none = F.array().cast(f"array<{kind}>")

    def over_block(state: Column, block: Column) -> Column:
        inner = F.struct(*(state[n].alias(n) for n in start), none.alias("out"))
        put = lambda s: F.struct(*(s[n].alias(n) for n in start), F.array_append(state["out"], s["out"]).alias("out"))
        return F.aggregate(block, inner, walk, put)

    numbers = lambda found: F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    blocks = let(items, lambda found: F.transform(numbers(found), lambda b: F.slice(found, b * BLOCK + 1, BLOCK)))
    outer = F.struct(*(c.alias(n) for n, c in start.items()), F.array().cast(f"array<array<{kind}>>").alias("out"))
    whole = lambda s: F.struct(*(s[n].alias(n) for n in start), F.flatten(s["out"]).alias("out"))
    return F.aggregate(blocks, outer, over_block, (lambda s: finish(whole(s))) if finish else (lambda s: F.flatten(s["out"])))


def chunks(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` code points, so that a place in it is found without reading up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, count: Column) -> Column:
    """``count`` code points from ``start`` (from 0) on of a text in ``chunks``."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + count - 1) / CHUNK).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(count > 0, F.substr(joined, start - first * CHUNK + 1, count)).otherwise(F.lit(""))
