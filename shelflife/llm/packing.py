"""Packing by optimal length buckets and token-budget batches.

Lengths are counted once over all documents. Dynamic programming over that histogram chooses the bucket bounds
with the least padding: a bucket pads each of its documents to its bound. Inside a bucket documents follow a
seeded order and fill batches of as many rows as the token budget allows, at least one.

Bounds are exact lengths up to 4095 words and one of 2048 steps per power of two above, so the histogram stays
small whatever the longest document is; a document never lies above its bound.

Defined cases: a null or empty text has length 0 and takes a row that is all padding; repeated rows are rows of
their own; an empty table gives an empty result.

The driver holds the histogram of bounds and one row per shard of ``SHARD_DOCS`` documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.llm.common import word_count, written

BUCKETS = 16
BATCH_TOKENS = 65_536
SEED = 5
SHARD_DOCS = 1 << 18
EXACT_BITS = 12


def grid(length: Column) -> Column:
    """The smallest allowed bound at or above a length."""
    bits = F.length(F.bin(length))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), bits - EXACT_BITS)).cast("long")
    return (F.ceil(length / step) * step).cast("long")


def best_bounds(histogram: Sequence[tuple[int, int, int]], buckets: int) -> list[int]:
    """Bounds of at most ``buckets`` buckets with the least padding in all.

    ``histogram`` holds (bound, documents, words) in ascending order of bound. Cost of a bucket that spans the
    entries i..j: bound[j] * documents - words. The best start for each end is the lower envelope of lines, as
    their slopes and the ends both ascend. Ties go to the earlier start.
    """
    if not histogram:
        return []
    bound = [b for b, _, _ in histogram]
    count, words = [0], [0]
    for _, c, w in histogram:
        count.append(count[-1] + c)
        words.append(words[-1] + w)
    n = len(bound)
    cost: list[int] = [bound[j] * count[j + 1] - words[j + 1] for j in range(n)]
    starts = [[0] * n]
    for _ in range(min(buckets, n) - 1):
        lines: list[tuple[int, int, int]] = []  # (documents before the start, value at 0, start)
        new, start, best = [], [], 0
        for j in range(n):
            # A start at j: everything before it is covered at the cost found so far.
            m, c = count[j], (cost[j - 1] if j else 0) + words[j]
            while len(lines) >= 2 and _useless(lines[-2], lines[-1], (m, c, j)):
                lines.pop()
            if not lines or lines[-1][0] != m or c < lines[-1][1]:
                lines.append((m, c, j))
            best = min(best, len(lines) - 1)
            x = bound[j]
            while best + 1 < len(lines) and lines[best + 1][1] - lines[best + 1][0] * x < lines[best][1] - lines[best][0] * x:
                best += 1
            m, c, i = lines[best]
            new.append(x * (count[j + 1] - m) + c - words[j + 1])
            start.append(i)
        starts.append(start)
        cost = new
    ends, j = [], n - 1
    for start in reversed(starts):
        ends.append(bound[j])
        j = start[j] - 1
        if j < 0:
            break
    return ends[::-1]


def _useless(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c; values c - m * x with m ascending."""
    return (c[1] - a[1]) * (b[0] - a[0]) <= (b[1] - a[1]) * (c[0] - a[0])


def pack(docs: DataFrame, doc_id="doc_id", text="text", buckets=BUCKETS, batch_tokens=BATCH_TOKENS, seed=SEED, shard_docs=SHARD_DOCS) -> DataFrame:
    """Per document: doc_id, n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket), row (from 0), padding."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), word_count(text).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("key")
    ).withColumn("bound", grid(F.col("n_tokens")))
    sized = written(sized, "pack")

    lengths = sized.groupBy("bound").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("words"))
    histogram = sorted((r["bound"], r["docs"], r["words"]) for r in lengths.collect())
    ends = best_bounds(histogram, buckets)
    plan, at = [], 0
    for k, end in enumerate(ends):
        docs_in = 0
        while at < len(histogram) and histogram[at][0] <= end:
            docs_in += histogram[at][1]
            at += 1
        plan.append((k, end, max(1, batch_tokens // max(1, end)), -(-docs_in // shard_docs)))
    bucket_of, low = [], -1
    for k, end in enumerate(ends):
        bucket_of += [(b, k) for b, _, _ in histogram if low < b <= end]
        low = end
    by_bound = spark.createDataFrame(bucket_of, "bound long, bucket int")
    by_bucket = spark.createDataFrame(plan, "bucket int, bucket_len long, batch_rows long, shards long")
    dealt = (
        sized.join(by_bound, "bound")
        .join(by_bucket, "bucket")
        .withColumn("shard", F.pmod(F.shiftright("key", 20), F.col("shards")))
    )
    # Rows are numbered within shards of bounded size; where a shard starts comes from the counts of those before.
    counts = dealt.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("docs")).collect()
    offsets, last, seen = [], None, 0
    for r in sorted(counts, key=lambda r: (r["bucket"], r["shard"])):
        seen = seen if r["bucket"] == last else 0
        offsets.append((r["bucket"], r["shard"], seen))
        last, seen = r["bucket"], seen + r["docs"]
    first = spark.createDataFrame(offsets, "bucket int, shard long, first_row long")
    in_order = Window.partitionBy("bucket", "shard").orderBy("key", "doc_id", "n_tokens")
    number = F.row_number().over(in_order) - 1
    return (
        dealt.withColumn("number", number)
        .join(first, ["bucket", "shard"])
        .withColumn("number", F.col("first_row") + F.col("number"))
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_len",
            F.expr("number div batch_rows").alias("batch"), (F.col("number") % F.col("batch_rows")).alias("row"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
