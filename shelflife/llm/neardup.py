"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set are the 64-bit hashes of its distinct shingles of five words. Documents with equal sets form a
class; all else works on classes. A class keeps its ``K`` smallest hashes as sketch. Inverted lists of the
retained values bring classes together, an estimate from the sketch of the union filters, and the exact Jaccard
of the full sets decides.

Which lists a class stands in: two sets with a Jaccard of 0.75 or more share at least ``SHARED`` retained values
(all that three quarters make, if the sketches are the whole sets; else all but one pair in 10^8 do). So it is
enough that each class stands in the lists of its rarest values, as many as may be missing plus one. Values
that only one class has come first in that order and need no list. So a passage that many documents share gives
no candidates unless it makes up most of a document.

Within a list not all pairs are formed. Each class is compared with one pivot; links join classes to components;
only then classes of different components are compared, in blocks that return links and no pairs. Classes of
one list that its pivot joins cost one comparison each.

Defined cases: a null text and one without words have an empty set and no link; a text with fewer words than a
shingle has has one shingle, the whole sequence; rows are judged by their text, so rows that repeat an id keep
their own component; a null id is never the smallest, a component without any id has a null component; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.llm.common import written
from shelflife.llm.components import components

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
K = 64
#: A binomial draw of K with probability 0.75 is smaller than this about once in 10^8.
SHARED = 27
#: Hashes of the sets a block of classes holds on average.
BLOCK_VALUES = 1 << 17
#: Word hashes a task remembers.
REMEMBERED = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        value = self[word] = value - (1 << 64) if value >> 63 else value
        return value


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([hashes[w] for w in words], np.int64).view(np.uint64)
    size = min(WORDS, len(codes))
    n = len(codes) - size + 1
    found = np.full(n, size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return np.unique(found)


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _with_sets(rows: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, text) to (doc_id, key, n, hashes): the sketch or, if ``whole``, the full set. Ordered unsigned."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _WordHashes()
        for batch in batches:
            texts = batch["text"]
            for at in range(0, len(texts), 256):
                found = [shingle_set(t, remembered) for t in texts.slice(at, 256).to_pylist()]
                columns = [
                    batch["doc_id"].slice(at, 256),
                    pa.array([_key(s) for s in found], pa.binary()),
                    pa.array([len(s) for s in found], pa.int64()),
                    _arrays([s if whole else s[:K] for s in found]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "hashes"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(sets, f"doc_id {kind}, key binary, n long, hashes array<long>")


def _shared_at_least(n: Column) -> Column:
    """Retained values that a set of n shingles shares with every set it is linked to."""
    return F.least(F.ceil(n * PERCENT / 100), F.lit(SHARED)).cast("int")


def index_entries(classes: DataFrame) -> DataFrame:
    """(key, n, doc_id, own, values): the classes that stand in lists, with the rarest values that another class has too.

    ``own`` is the share of its retained values that no other class has.
    """
    values = classes.select("key", F.explode("hashes").alias("value"))
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    # Classes that have such values, with them rarest first.
    listed = values.join(common, "value").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("classes", "value"))).alias("values"))
    size = F.least("n", F.lit(K)).cast("int")
    may_miss = size - _shared_at_least(F.col("n"))
    alone = size - F.size("values")
    entries = listed.join(classes.select("key", "n", "doc_id"), "key").withColumn("take", may_miss + 1 - alone).where("take > 0")
    rarest = F.transform(F.slice("values", F.lit(1), F.col("take")), lambda v: v["value"])
    return entries.select("key", "n", "doc_id", (alone / size).alias("own"), rarest.alias("values"))


def _lists(entries: DataFrame, *columns: str) -> DataFrame:
    """(value, ...): a row for each list a class stands in."""
    return entries.select(F.explode("values").alias("value"), *columns)


def _sizes_fit(n_a: Column, n_b: Column) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("key != other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()


def pivot_pairs(entries: DataFrame) -> DataFrame:
    """Each class of a list with the list's pivot, the class that has least of its own."""
    lists = _lists(entries, "key", "n", "own")
    pivots = lists.groupBy("value").agg(F.min(F.struct("own", "key", "n")).alias("p")).select("value", F.col("p.key").alias("other"), F.col("p.n").alias("other_n"))
    return _pairs(lists.join(pivots, "value").where(_sizes_fit(F.col("n"), F.col("other_n"))))


def crossing_links(entries: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between classes of one list that lie in different components, as the roots (a, b) of these components.

    Lists that hold more than one component, and more than the pair a pivot has settled, are gathered by the
    component most of their classes are in, the top. Nothing is to be compared within the top, so a gathering's top
    and its other classes are dealt into blocks of their own, of some ``BLOCK_VALUES`` hashes. Each block of others
    meets each block in a group, which compares full sets and returns links only.
    """
    placed = written(entries.join(roots, "key", "left").select("key", "n", "values", F.coalesce("root", "key").alias("root")), "placed")
    lists = _lists(placed, "key", "n", "root")
    mixed = (
        lists.groupBy("value", "root")
        .agg(F.count(F.lit(1)).alias("classes"))
        .groupBy("value")
        .agg(F.max(F.struct("classes", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("classes").alias("classes"))
        .where("roots > 1 and classes > 2")
        .select("value", F.col("top.root").alias("top"))
    )
    gathered = written(lists.join(mixed, "value").select("top", "key", "n", "root").distinct(), "gathered")
    rows = _meetings(gathered).join(sets, "key").select("top", F.explode("meet").alias("meet"), "key", "root", "block", "hashes")
    rows = rows.select("top", "meet.low", "meet.high", "key", "root", "block", "hashes")
    return rows.groupBy("top", "low", "high").applyInArrow(_links_within, "a binary, b binary")


def _meetings(gathered: DataFrame) -> DataFrame:
    """(top, key, root, block, meet): the block of each gathered class, and the groups (low, high) it goes to."""
    in_top, zero = F.col("root") == F.col("top"), F.lit(0)
    blocks_of = lambda n: F.ceil(F.sum(n) / BLOCK_VALUES).cast("int")
    blocks = gathered.groupBy("top").agg(
        blocks_of(F.when(in_top, zero).otherwise(F.col("n"))).alias("others"), blocks_of(F.when(in_top, F.col("n")).otherwise(zero)).alias("tops")
    )
    # Blocks of others are numbered from 0, those of the top after them.
    block = F.when(in_top, F.col("others") + F.pmod(F.xxhash64("key"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("key"), F.col("others"))).cast("int")
    last = F.when(in_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    meet = F.transform(
        F.sequence(zero, last),
        lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high")),
    )
    return gathered.join(blocks, "top").where("others > 0").withColumn("block", block).select("top", "key", "root", "block", meet.alias("meet"))


def _links_within(group: pa.Table) -> pa.Table:
    """Components between whose classes there are links, by their roots; of two blocks only links across."""
    keys, roots, block = group["key"].to_pylist(), group["root"].to_pylist(), group["block"].to_numpy()
    top, across = group["top"][0].as_py(), group["low"][0].as_py() != group["high"][0].as_py()
    column = group["hashes"].combine_chunks()
    codes = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    sizes = np.diff(starts)
    component = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
    order = np.argsort(np.argsort(np.array([k.hex() for k in keys])))
    in_top = np.array([r == top for r in roots])
    mark = np.zeros(len(codes) + 1, bool)
    found = set()
    for x in np.flatnonzero(~in_top):
        other = (component != component[x]) & (in_top | (order > order[x]))
        other &= np.minimum(sizes, sizes[x]) * 100 >= np.maximum(sizes, sizes[x]) * PERCENT
        if across:
            other &= block != block[x]
        if other.any():
            own = codes[starts[x] : starts[x + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[codes], starts[:-1], dtype=np.int64)
            mark[own] = False
            for y in np.flatnonzero(other & (both * 100 >= PERCENT * (sizes + sizes[x] - both))):
                found.add((min(roots[x], roots[y]), max(roots[x], roots[y])))
    a, b = zip(*sorted(found)) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _may_be_linked(a: Column, b: Column) -> Column:
    """The estimate: of the K smallest values of both sketches, enough are in both. Order is that of unsigned."""
    unsigned = F.transform(F.array_union(a, b), lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    union = F.transform(F.slice(F.array_sort(unsigned), 1, K), lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
    shared = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    needed = F.when(F.size(union) < K, F.size(union) * PERCENT / 100).otherwise(F.lit(SHARED))
    return shared >= needed


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that the sketches allow and the full sets confirm."""
    sketch = lambda side: classes.select(F.col("key").alias(side), F.col("hashes").alias(f"sketch_{side}"))
    likely = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(_may_be_linked(F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")
    full = lambda side: sets.select(F.col("key").alias(side), F.col("hashes").alias(f"set_{side}"))
    # The pairs lie by b here, and need not be dealt by it again.
    compared = likely.join(full("b"), "b").join(full("a"), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        compared.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
        .where(F.col("both") * 100 >= PERCENT * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, key (of its shingle set), n_shingles, component_id, kept."""
    return _rooted(docs, doc_id, text).drop("root")


def _rooted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``near_duplicates`` with the root of each row's component, which is null for an empty set."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = written(_with_sets(rows, whole=False), "sketches")
    classes = members.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("hashes").alias("hashes")
    )
    classes = written(classes, "classes")
    entries = written(index_entries(classes), "entries")

    # Full sets of the classes that stand in a list, from the text of one of their documents.
    ids = entries.select(F.col("doc_id").alias("id")).distinct()
    texts = rows.join(ids.hint("merge"), rows["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    sets = _with_sets(texts, whole=True).join(entries.select("key"), "key", "left_semi")
    sets = written(sets.dropDuplicates(["key"]).select("key", "hashes"), "sets")

    links = written(verified(pivot_pairs(entries), classes, sets), "linked")
    roots = components(links)
    placed = classes.join(roots, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    crossing = written(crossing_links(entries, roots, sets), "linked")
    if not crossing.isEmpty():
        joined = components(crossing).select(F.col("key").alias("root"), F.col("root").alias("joined"))
        placed = placed.join(joined, "root", "left").select("key", "doc_id", F.coalesce("joined", "root").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    components_of = placed.join(lowest, "root").select("key", "component_id", "root")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        members.select("doc_id", "key", "n")
        .join(components_of, "key", "left")
        .select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), "root")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row of each component of ``near_duplicates``, and the rows with empty sets.

    Of a component's kept rows, which are several if ids are null or repeated, the first by key, text and the
    other columns stays.
    """
    # Id and key in one column: rows are never dealt by the key alone, which a group of copies shares.
    pair = lambda key: F.struct(F.col(doc_id).alias("id"), F.col(key).alias("key"))
    found = _rooted(docs, doc_id, text).where("kept")
    # The kept rows of a component agree in their id.
    sets = found.groupBy("root", "key", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    alone = F.when(F.col("key").isNull(), F.col("doc_id"))
    least = sets.groupBy("root", alone.alias("alone")).agg(F.min(F.struct("key", F.col("doc_id").alias("id"), "times")).alias("least"))
    kept = written(least.select(F.struct("least.id", "least.key").alias("__kept"), F.col("least.times").alias("__times")), "kept")
    once = F.col("__times").eqNullSafe(1) | F.col("__kept.key").isNull()
    single = _keyed(docs, text).join(kept.where(once), pair("__key").eqNullSafe(F.col("__kept"))).select(docs.columns)
    several = kept.where(~once)
    if several.isEmpty():
        return single
    # Only rows whose id such a set has are looked at again.
    ids = several.select("__kept.id").distinct()
    again = _keyed(docs.join(ids, docs[doc_id].eqNullSafe(ids["id"]), "left_semi"), text)
    first = Window.partitionBy("__kept").orderBy(text, *(c for c in docs.columns if c not in (doc_id, text)))
    rows = again.join(several, pair("__key").eqNullSafe(F.col("__kept"))).withColumn("__row", F.row_number().over(first))
    return single.union(rows.where("__row = 1").select(docs.columns))


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the key of their shingle sets in ``__key``."""
    names = docs.columns

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = _WordHashes()
        for batch in batches:
            found = [_key(shingle_set(t.as_py(), remembered)) for t in batch[text]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(found, pa.binary())], [*names, "__key"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(keys, ", ".join([*fields, "__key binary"]))
