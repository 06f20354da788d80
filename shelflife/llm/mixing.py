"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: the total is shared over the sources by weight; a source never gets more than ``cap`` times its own
words, and what is cut off is shared again by weight until no source is above its cap. The words of the total are
blocks of equal size, which go one by one to the source with the highest quotient target / (2 * blocks + 1), then in
the same way from a source to its shards; one that has ``cap`` times its words gets no more. A shard lays its
documents one after the other in a seeded order and takes its blocks from the front, going round again when it
reaches the end.

A block is one word, so a source misses its target by about a word, however small it is. What a divisor somewhat too
large gives is dealt at once and only the last few blocks by quotient, so their number costs nothing.

Rows with the same id are documents of their own. A document without words takes none. Shard and order come from the
md5 of seed, id and text, so rows without an id, or with one id, are dealt to all shards of their source; of rows equal
in both, which have equal sizes, any may come first unless columns to keep tell them apart. Sources are ordered by
code point, null last. An empty table gives an empty result.

The driver holds one row per source. The sums of a source's shards, one number per ``SHARD_DOCS`` documents,
meet in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.llm.common import WORD, word_count, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Documents a shard holds on average: the rows one task sorts.
SHARD_DOCS = 1 << 13


def targets(sizes: Sequence[int], weights: Sequence[int], cap: int = CAP) -> list[float]:
    """Words each source shall give: shares of all words by weight, none above ``cap`` times its size."""
    total, order = sum(sizes), sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    left, weight, out = total, sum(weights), [0.0] * len(sizes)
    for i in order:  # from the source that meets its cap first
        if cap * sizes[i] * weight < left * weights[i]:
            out[i] = float(cap * sizes[i])
            left, weight = left - cap * sizes[i], weight - weights[i]
        else:
            out[i] = left * weights[i] / weight
    return out


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1), none above its limit; ties go to the earlier entry."""
    total, limits = sum(votes), limits or [seats] * len(votes)
    if not total or not seats:
        return [0] * len(votes)
    # Every entry surely gets what a divisor somewhat too large gives it; the rest is dealt by quotient.
    divisor = total / max(1, seats - len(votes))
    got = [min(limit, max(0, int(v / divisor - 0.5))) for v, limit in zip(votes, limits)]
    queue = [(-v / (2 * n + 1), i) for i, (v, n, limit) in enumerate(zip(votes, got, limits)) if v > 0 and n < limit]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        if not queue:
            break
        _, i = queue[0]
        got[i] += 1
        if got[i] < limits[i]:
            heapq.heapreplace(queue, (-votes[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(queue)
    return got


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, cap=CAP, seed=SEED, shard_docs=SHARD_DOCS, keep=()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, passes, words_from, words_to, taken.

    The mix holds a document ``passes`` times in full and once more from its word ``words_from`` to before
    ``words_to``; ``taken`` are the words this makes. ``keep`` names further columns to return.
    """
    spark = docs.sparkSession
    own = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), own))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("key"), *keep
    )
    sized = written(sized, "mix")

    per_source = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in per_source]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    blocks = sainte_lague(goals, sum(sizes), [cap * n for n in sizes])
    plan = [
        (i, r["source"], r["words"], goals[i], -(-r["docs"] // shard_docs), blocks[i]) for i, r in enumerate(per_source)
    ]
    sources = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, shards long, blocks long")

    number = F.conv(F.substr("key", F.lit(1), F.lit(8)), 16, 10).cast("long")
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "doc_id", sized["source"], "size", "key", "source_no", "source_size", "target", "blocks", F.pmod(number, F.col("shards")).alias("shard"), *keep
    )

    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        words = [int(w) for w in shards["shard_words"]]
        quota = sainte_lague([float(w) for w in words], int(shards["blocks"].iloc[0]), [cap * w for w in words])
        return shards[["source_no", "shard", "shard_words"]].assign(quota=quota)

    per_shard = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("shard_words"), F.max("blocks").alias("blocks"))
    shards = per_shard.groupBy("source_no").applyInPandas(quotas, "source_no int, shard long, shard_words long, quota long")

    in_order = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size", *([F.xxhash64(*keep)] if keep else []))
    at = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    passes = F.when(F.col("shard_words") > 0, F.expr("quota div shard_words")).otherwise(F.lit(0).cast("long"))
    rest = F.col("quota") - F.col("passes") * F.col("shard_words")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("at")))
    return (
        dealt.withColumn("at", at)
        .join(shards, ["source_no", "shard"])
        .withColumn("passes", passes)
        .withColumn("words_to", part)
        .select(
            "doc_id", "source", "size", "source_size", "target", "passes", F.lit(0).cast("long").alias("words_from"), "words_to",
            (F.col("passes") * F.col("size") + F.col("words_to")).alias("taken"), *keep,
        )
    )


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its first ``count`` words."""
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0)
    return F.array_join(F.slice(words, 1, count.cast("int")), "")
