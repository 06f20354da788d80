"""A training corpus from documents: the stages in order, and the run that applies them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.llm import langid, mixing, neardup, packing, pii
from shelflife.llm.common import read_table, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _any_columns(stage: Callable) -> Callable:
    """A stage that gives back the columns it was given; those that documents do not have are called ``extra_0`` and so
    on meanwhile, so whatever their names are, none is a name the stage uses inside."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apart = docs.toDF(*(c if c in DOCUMENT else f"extra_{k}" for k, c in enumerate(docs.columns)))
        return stage(spark, apart, sf_dir).toDF(*docs.columns)

    return run


@_any_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the others (no letter, or too few known n-grams) go.

    A null lang becomes the recognised one; a given lang stays.
    """
    found = langid.identify(docs, langid.trained(docs), names=("__lang", "__score"))
    kept = found.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") > 0))
    return kept.withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


@_any_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; of repeated rows one."""
    return neardup.deduplicated(docs)


@_any_columns
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@_any_columns
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, the last time cut after the words it takes; n_chars follows.

    Rows are documents of their own, also where they agree in all columns.
    """
    # Whole rows in one column, so that no column of theirs meets a name of the mix.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    mixed = mixing.mix(rows, "row.doc_id", "row.text", "row.source", keep=["row"])
    text, passes = F.col("row.text"), F.col("passes").cast("int")
    part = F.when(F.col("words_to") > 0, F.array(mixing.first_words(text, F.col("words_to")))).otherwise(F.array().cast("array<string>"))
    taken = mixed.select("row", F.explode(F.concat(F.array_repeat(text, passes), part)).alias("taken"))
    new = {"text": F.col("taken"), "n_chars": F.length("taken").cast("long")}
    return taken.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and row of every document."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near-duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
