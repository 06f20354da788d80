"""Connected components of links between keys, by alternating large and small stars on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelflife.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    node = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
    return down.join(least, "a").select(node.alias("a"), F.col("least").alias("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each key is linked to one other, which is linked to none: components then need no further round."""
    ends = edges.select(F.col("a").alias("key"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    per_key = ends.groupBy("key").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per_key.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), a written table, to (key, root): every linked key with the least key of its component.

    Each round is written to the shared folder; rounds end when all components are stars around their least key,
    after about the logarithm of the longest chain of rounds.
    """
    edges = written(_small_star(_large_star(links)), "links")
    while not _are_stars(edges):
        edges = written(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
