"""SimHash near-duplicates by tables of distances to reference fingerprints.

A document's fingerprint has 64 bits: a bit is set if it is set in more than half of the XXH64 values of the
document's shingles of three words, repeats included. Equal fingerprints form a class; all else works on classes.

Every fingerprint has a row in a table of its Hamming distances to ``REFERENCES`` fixed fingerprints. The distance of
two fingerprints is at least the largest difference between their rows, so pairs whose rows differ by more than
``BITS`` anywhere are discarded; the survivors are verified bit by bit.

Which fingerprints meet: of four bands of bits, three differing bits leave one untouched, and there the distances to
all references that differ in this band only are equal. These say the same as the band's bits, so fingerprints meet
by the bits of a band. Buckets of more than ``BUCKET`` fingerprints are dealt again by four bands of the bits not
yet used, until none is larger; nothing is left out, since the argument holds again for the bits that are left.
Buckets are compared by shifts of their order, without forming their pairs, and two that are joined already are not
compared, so a group gives at most as many links as it has members.

Defined cases: a null text and one without words have the fingerprint zero, which is linked like any other; a text
with fewer words than a shingle has has one shingle, the whole sequence; rows that repeat an id keep the component
of their own text; a null id is never the smallest, a component without any id has a null component; an empty table
gives an empty result. A text is hashed in steps of ``STEP`` shingles, so a long one costs time and little memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shelflife.llm.common import written
from shelflife.llm.components import components
from shelflife.operators.joins import join_per_key

WORDS = 3
HASH_SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
BITS = 3
BANDS = BITS + 1
#: Reference fingerprints, and how many of them are tried first.
REFERENCES = 16
FIRST = 4
REFERENCE_SEED = 11
#: Fingerprints that are compared as one bucket.
BUCKET = 2048
#: Fingerprints a task compares at a time, on average.
GROUP = 1 << 14
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(WORDS, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t.as_py()) for t in part["text"]], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def references(count: int = REFERENCES, seed: int = REFERENCE_SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, count, np.uint64)


def distance_table(found: np.ndarray) -> np.ndarray:
    """One row per fingerprint: its distances to the references."""
    return np.bitwise_count(found[:, None] ^ references()[None, :]).astype(np.int8)


def _bands(free: int) -> list[int]:
    """Four bands of the bits that are set in a mask."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << int(k) for k in band) for band in np.array_split(bits, BANDS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, free: list[int]) -> DataFrame:
    """(fp, key, path) to four rows each, by the bands of the bits a path has left."""
    bands = F.array(*(F.array(*(F.lit(_signed(b)) for b in _bands(f))) for f in free))
    each = rows.select("fp", "key", "path", F.posexplode(F.get(bands, F.col("path"))).alias("band", "mask"))
    path = (F.col("path") * BANDS + F.col("band")).alias("path")
    return each.select("fp", F.xxhash64("key", path, F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), path)


def _links_within(group: pa.Table) -> pa.Table:
    """Links (a, b) that join what is linked within each key, by shifts of the rows in order of their key."""
    key, found = group["key"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((found, key))
    key, found = key[order], found[order]
    table, root = distance_table(found), np.arange(len(found))
    rows, out, shift = np.arange(len(found)), [], 0
    while True:
        shift += 1
        rows = rows[rows + shift < len(found)]
        rows = rows[key[rows] == key[rows + shift]]
        if not len(rows):
            break
        a = rows[root[rows] != root[rows + shift]]
        for columns in (slice(0, FIRST), slice(FIRST, None)):
            a = a[(np.abs(table[a, columns] - table[a + shift, columns]) <= BITS).all(axis=1)]
        a = a[np.bitwise_count(found[a] ^ found[a + shift]) <= BITS]
        for x in a.tolist():
            p, q = x, x + shift
            while root[p] != p:
                p = root[p]
            while root[q] != q:
                q = root[q]
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, x + shift))
        while len(a) and not np.array_equal(above := root[root], root):
            root = above
    ends = np.array(out, np.int64).reshape(-1, 2)
    a, b = (found[ends[:, side]].view(np.int64) for side in (0, 1))
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def linked(classes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join all that is linked."""
    spark = classes.sparkSession
    rows, free, links = classes.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("path")), [(1 << 64) - 1], None
    while True:
        dealt = written(_dealt(rows, free), "dealt")
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if largest > BUCKET:
            # Keys of large buckets, repeated so that the rows of one are spread over tasks.
            salts = 16
            large = sizes.where(F.col("n") > BUCKET).select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
            salted = dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
            rows = written(salted.join(large, ["key", "salt"], "left_semi").drop("salt"), "dealt")
            dealt = salted.join(large, ["key", "salt"], "left_anti").drop("salt")
        group = F.pmod("key", F.lit(max(1, -(-total // GROUP))))
        found = dealt.groupBy(group.alias("group")).applyInArrow(_links_within, "a long, b long")
        links = found if links is None else links.union(found)
        if largest <= BUCKET:
            return written(links, "linked")
        free = [f & ~b for f in free for b in _bands(f)]


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    members = written(fingerprints(docs, doc_id, text), "fingerprints")
    classes = written(members.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = components(linked(classes))
    placed = written(
        classes.join(roots, F.col("fp") == F.col("key"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    component = join_per_key(placed, lowest, "root", "classes").select("fp", "rows", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_per_key(members, component, "fp", "rows").select("doc_id", digits.alias("fingerprint"), "component_id")
