"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text is cut into paragraphs at line feeds, a long paragraph into pieces of some sentences; where there is neither
sentence nor white space, as in Chinese or encoded text, where a rolling hash of the last code points says so; the
paragraphs of a short text into words, or a few code points of what has none. Paragraphs form
sections: a section ends with an empty paragraph or with one whose digest says so, so an inserted paragraph
changes the section it stands in and no other. A leaf is the SHA-256 of a piece, an inner node that of its
children's digests. The root covers the text byte by byte: equal texts, and only those, have equal roots.

The fingerprint is ``root:leaves``: the root in hex and, in base64, 12 bytes per piece: 8 of its digest and 4
of its code points and whether it ends a paragraph and a section. So two fingerprints can be compared without
the texts: equal roots end the comparison, else equal sections, then paragraphs, then pieces are set off, and
what stays are the branches in which the texts differ.

Defined cases: a null text is the empty text, whose tree has one empty piece; two empty texts have likeness 1;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

#: A paragraph is cut after a sentence once a piece has 48 code points, at white space once it has 256.
PIECE = re.compile(r"(?s).{48,255}?[.!?](?=\s)|.{256,}?(?=\s)|.+")
#: A longer piece has no white space to be cut at, and is cut by content.
LONGEST = 512
#: Texts of fewer code points are cut into words.
SHORT = 192
WORD = re.compile(r"(?s)\S+\s*|\s+")
SECTION_ODDS = 4
LEAF = struct.Struct(">8sI")


def cut_by_content(run: str, window: int, bits: int, least: int, most: int) -> list[str]:
    """A run in pieces of ``least`` to ``most`` code points that end where ``bits`` bits of a hash of the last ``window``
    code points are 0, so that an edit moves only the cuts near it."""
    codes = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashes = np.zeros(len(codes), np.uint64)
    for k in range(window):
        hashes[k:] = hashes[k:] + (codes[: len(codes) - k] + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    hashes ^= hashes >> np.uint64(29)
    ends = (np.flatnonzero((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits) == 0) + 1).tolist()
    out, at = [], 0
    for end in [*ends, len(run)]:
        while end - at > most:
            out.append(run[at : at + most])
            at += most
        if end - at >= least or end == len(run) and end > at:
            out.append(run[at:end])
            at = end
    return out


def pieces_of(paragraph: str, short: bool) -> list[str]:
    """The pieces of a paragraph, at least one."""
    if short:
        found = [p for w in WORD.findall(paragraph) for p in (cut_by_content(w, 1, 1, 2, 8) if len(w) > 16 else [w])]
    else:
        found = [p for w in PIECE.findall(paragraph) for p in (cut_by_content(w, 8, 6, 16, 256) if len(w) > LONGEST else [w])]
    return found or [""]


def _sha(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    leaves, sections, section = [], [], []
    paragraphs = (text or "").split("\n")
    last, short = len(paragraphs) - 1, len(text or "") < SHORT
    for k, paragraph in enumerate(paragraphs):
        pieces = pieces_of(paragraph, short)
        digests = [_sha(p.encode()) for p in pieces]
        node = _sha(b"p" + b"".join(digests))
        section.append(node)
        ends = k == last or not paragraph or node[0] % SECTION_ODDS == 0
        for piece, digest in zip(pieces, digests):
            leaves.append([digest[:8], min(len(piece), (1 << 30) - 1) << 2])
        leaves[-1][1] |= 3 if ends else 1
        if ends:
            sections.append(_sha(b"s" + b"".join(section)))
            section = []
    root = _sha(b"r" + b"".join(sections)).hex()
    return f"{root}:{base64.b64encode(b''.join(LEAF.pack(*x) for x in leaves)).decode()}"


def _tree(mark: str) -> tuple[str, list[list[tuple]]]:
    """Root and sections; a section is a list of paragraphs, a paragraph a tuple of (digest, code points)."""
    root, _, leaves = mark.partition(":")
    sections, section, paragraph = [], [], []
    for digest, bits in LEAF.iter_unpack(base64.b64decode(leaves)):
        paragraph.append((digest, bits >> 2))
        if bits & 1:
            section.append(tuple(paragraph))
            paragraph = []
        if bits & 2:
            sections.append(section)
            section = []
    return root, sections


def _set_off(a: list, b: list) -> tuple[list, list, list]:
    """What both lists hold, with repeats, and what is left of each."""
    spare = Counter(b)
    both, rest = [], []
    for x in a:
        if spare[x] > 0:
            spare[x] -= 1
            both.append(x)
        else:
            rest.append(x)
    left = []
    for x in reversed(b):
        if spare[x] > 0:
            spare[x] -= 1
            left.append(x)
    return both, rest, left[::-1]


def differing(a: str, b: str) -> tuple[list[tuple], list[tuple]]:
    """The (digest, code points) pieces only one of two fingerprinted texts has, in order."""
    (root_a, tree_a), (root_b, tree_b) = _tree(a), _tree(b)
    if root_a == root_b:
        return [], []
    _, a, b = _set_off([tuple(s) for s in tree_a], [tuple(s) for s in tree_b])
    _, a, b = _set_off([p for s in a for p in s], [p for s in b for p in s])
    _, a, b = _set_off([leaf for p in a for leaf in p], [leaf for p in b for leaf in p])
    return a, b


def edited_ranges(a: str, b: str) -> list[tuple[int, int]]:
    """Code point ranges of the first text that the second does not have, by their fingerprints alone.

    Of equal pieces the earlier ones count as those both texts have.
    """
    only = Counter(differing(a, b)[0])
    leaves = [leaf for section in _tree(a)[1] for paragraph in section for leaf in paragraph]
    both = Counter(leaves) - only
    ranges, at = [], 0
    for section in _tree(a)[1]:
        for paragraph in section:
            for leaf in paragraph:
                end = at + leaf[1]
                if both[leaf] > 0:
                    both[leaf] -= 1
                elif ranges and ranges[-1][1] == at:
                    ranges[-1] = (ranges[-1][0], end)
                else:
                    ranges.append((at, end))
                at = end
            at += 1  # the line feed
    return ranges


def _size(mark: str) -> int:
    return sum(bits >> 2 for _, bits in LEAF.iter_unpack(base64.b64decode(mark.partition(":")[2])))


def likeness(a: str, b: str) -> float:
    """Share of code points, of both texts together, that lie in pieces both have; 1 for equal roots only."""
    if a == b or a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    total = _size(a) + _size(b)
    only_a, only_b = differing(a, b)
    apart = sum(n for _, n in only_a) + sum(n for _, n in only_b)
    return max(0.0, min(1 - 1e-9, 1 - apart / total)) if total else 0.0


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Per document: doc_id and its fingerprint."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(t) for t in batch["text"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], marks], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(mark, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def with_next(docs: DataFrame, slots: int | None = None) -> DataFrame:
    """Rows (slot, ahead, doc_id, text) such that sorting a slot by (ahead, doc_id desc, text) puts each document's
    next one, in descending order of ids, behind it.

    Slots are ranges of ids of about equal numbers. The first document of the following slot is repeated at the
    end of each slot (``ahead``), and the very first one at the end of the last. Null ids come last; equal ids
    are ordered by text. The driver holds one id per slot.
    """
    spark = docs.sparkSession
    slots = slots or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [k / slots for k in range(1, slots)]
    cuts = sorted(set(docs.approxQuantile("doc_id", at, 0.1 / slots))) if at else []
    bucketizer = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__id", outputCol="__up", handleInvalid="keep")
    ranged = bucketizer.transform(docs.withColumn("__id", F.col("doc_id").cast("double"))) if cuts else docs.withColumn("__up", F.lit(0.0))
    null_slot = len(cuts) + 1
    slot = F.when(F.col("doc_id").isNull(), null_slot).otherwise(len(cuts) - F.col("__up").cast("int"))
    rows = ranged.select(slot.alias("slot"), F.lit(False).alias("ahead"), "doc_id", "text")
    firsts = sorted((r["slot"], r["id"]) for r in rows.groupBy("slot").agg(F.max("doc_id").alias("id")).collect())
    if not firsts:
        return rows
    heads = [(slot, firsts[(k + 1) % len(firsts)][1]) for k, (slot, _) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, f"slot int, head {dict(docs.dtypes)['doc_id']}")
    ahead = docs.join(F.broadcast(heads), docs["doc_id"].eqNullSafe(heads["head"]))
    return rows.union(ahead.select("slot", F.lit(True), "doc_id", "text"))


def compare_edited(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Fingerprints of each text and of an edited one, whose last half is the beginning of the next document.

    Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = with_next(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    ordered = rows.repartition("slot").sortWithinPartitions("slot", "ahead", F.col("doc_id").desc_nulls_last(), "text")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    columns = [part.split()[0] for part in schema.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, types = [], None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*found), types)]
            return pa.RecordBatch.from_arrays(arrays, columns)

        def rows_of() -> Iterator[tuple]:
            nonlocal types
            for batch in batches:
                text = pa.string()
                types = [batch.schema.field("doc_id").type, pa.int64(), text, text, text, pa.float64(), pa.float64()]
                yield from zip(*(batch[c].to_pylist() for c in ("slot", "ahead", "doc_id", "text")))

        for _, rows in groupby(rows_of(), key=lambda r: r[0]):
            previous = own = None
            over = False
            for _, ahead, doc, text in rows:
                if over:
                    continue  # of several documents with the id of the one ahead only the first follows
                mark = fingerprint(text)
                if previous is not None:
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    changed = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode()).hexdigest()
                    before = previous[1]
                    done.append((previous[0], len(own), sha, before, changed, likeness(before, changed), likeness(before, mark)))
                    if len(done) >= 500:
                        yield batch_of(done)
                        done = []
                previous, own, over = (doc, mark), text, ahead
        if done:
            yield batch_of(done)

    return ordered.mapInArrow(compare, schema)
