"""Document likelihood over the lattice of all subword segmentations.

A public tokenizer's pieces are the vocabulary. A word is written with a mark in front; its probability is the
sum over all ways to split it into pieces of the product of their probabilities, by forward recursion in log
space. Every code point can also be spelled by its UTF-8 byte pieces, so no word has probability 0. A document
is its words and one end symbol; pieces and end symbol share probability 1.

The piece probabilities start from the vocabulary's own scores (a merge rank r weighs 1 / (r + OFFSET)) and
are re-estimated by expectation maximisation on the words of the training documents, with the start as prior.

The corpus is cut into blocks of some ``BLOCK_TOKENS`` words. A block holds its documents as numbers into its
own word list, so only the distinct words of a block are shuffled: they meet by word, are counted and scored
once, and go back to their block. Memory follows the block, and a word that is in every text comes once per block.

Defined cases: a null text is the empty text, whose only token is the end; repeated rows are rows of their own;
without training documents the start probabilities score; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.llm.common import held_out, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OFFSET = 3
PRIOR_TOKENS = 1000.0
ROUNDS = 2
BLOCK_TOKENS = 1 << 21
#: Code points of words that a task scores together.
POINTS_TOGETHER = 1 << 19
MODULUS = 7
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Stands for the mark in front of a word; no text holds this number.
_FRONT = 0x110000


def _hash(codes: list[int]) -> int:
    value = 0
    for c in codes:
        value = (value * int(_STEP) + c + 1) & 0xFFFFFFFFFFFFFFFF
    return value


@dataclass
class Lattice:
    """Piece probabilities with the tables to find pieces in words."""

    prefixes: np.ndarray  # sorted hashes of all beginnings of pieces
    piece_of: np.ndarray  # the piece a beginning is, or -1
    log_p: np.ndarray  # by piece: first the 256 bytes, then the others, last the end symbol

    @staticmethod
    def start(pieces: list[tuple[str, float]]) -> Lattice:
        """From (piece, score) in order of rank; pieces a lower-cased word cannot hold are left out."""
        found: dict[int, int] = {}
        weights = [1.0 / (len(pieces) + OFFSET)] * 256
        for piece, score in pieces:
            codes = [_FRONT if k == 0 and c == MARK else ord(c) for k, c in enumerate(piece)]
            if MARK in piece[1:] or any("A" <= c <= "Z" or c in "\t\n\v\f\r " for c in piece):
                continue
            for n in range(1, len(codes)):
                found.setdefault(_hash(codes[:n]), -1)
            found[_hash(codes)] = len(weights)
            weights.append(1.0 / (-score + OFFSET))
        weights.append(max(weights))
        keys = np.array(sorted(found), np.uint64)
        p = np.array(weights)
        return Lattice(keys, np.array([found[int(k)] for k in keys]), np.log(p / p.sum()))

    def reestimated(self, counts: np.ndarray, prior: Lattice) -> Lattice:
        p = counts + PRIOR_TOKENS * np.exp(prior.log_p)
        return Lattice(self.prefixes, self.piece_of, np.log(p / p.sum()))

    def _edges(self, words: list[str]):
        """Edges (from, to, piece or -1 for bytes, log probability), positions running over all words."""
        lengths = np.array([len(w) + 1 for w in words])
        points = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        points[first] = _FRONT
        end = np.repeat(first + lengths, lengths)  # where the word of a position ends
        at = np.arange(len(points))
        hashed = np.zeros(len(points), np.uint64)
        starts, ends, pieces = [], [], []
        n = 0
        while len(at):
            hashed = hashed * _STEP + points[at + n].astype(np.uint64) + np.uint64(1)
            slot = np.minimum(np.searchsorted(self.prefixes, hashed), len(self.prefixes) - 1)
            known = self.prefixes[slot] == hashed
            at, hashed, slot = at[known], hashed[known], slot[known]
            n += 1
            piece = self.piece_of[slot]
            whole = piece >= 0
            starts.append(at[whole])
            ends.append(at[whole] + n)
            pieces.append(piece[whole])
            more = at + n < end[at]
            at, hashed = at[more], hashed[more]
        # A word's mark has a piece of its own in any vocabulary; every other code point can be spelled in bytes.
        spelled = np.flatnonzero(points != _FRONT)
        codes, which = np.unique(points[spelled], return_inverse=True)
        by_code = np.array([sum(self.log_p[b] for b in chr(c).encode()) for c in codes]) if len(codes) else np.zeros(0)
        starts, ends, pieces = (np.concatenate(x) for x in (starts, ends, pieces))
        logs = np.concatenate([self.log_p[pieces], by_code[which]])
        return (
            lengths, first, codes, which,
            np.concatenate([starts, spelled]), np.concatenate([ends, spelled + 1]),
            np.concatenate([pieces, np.full(len(spelled), -1)]), logs,
        )

    @staticmethod
    def _sums(values: np.ndarray, groups: np.ndarray, out: np.ndarray) -> None:
        """out[g] = log of the sum of exp over the values of each group; groups are sorted."""
        cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        top = np.maximum.reduceat(values, cut)
        sizes = np.diff(np.append(cut, len(values)))
        total = np.add.reduceat(np.exp(values - np.repeat(top, sizes)), cut)
        out[groups[cut]] = top + np.log(total)

    def _walk(self, lengths, first, starts, ends, logs, forward: bool) -> np.ndarray:
        """Log sums over all paths from a word's front to each node, or from each node to the word's end.

        Node p of a word stands before its position p; a word of n positions has n + 1 nodes, so nodes are
        numbered apart from positions: node = position + number of the word.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)[starts]
        source, target = starts + word, ends + word
        if not forward:
            source, target = target, source
        n_nodes = int(lengths.sum()) + len(lengths)
        front = first + np.arange(len(lengths))
        depth = (target - front[word]) if forward else (front + lengths)[word] - target
        order = np.argsort(depth * n_nodes + target)
        source, target, logs, depth = source[order], target[order], logs[order], depth[order]
        out = np.full(n_nodes, -np.inf)
        out[front if forward else front + lengths] = 0.0
        cuts = np.searchsorted(depth, np.arange(1, depth[-1] + 2)) if len(depth) else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                with np.errstate(invalid="ignore"):
                    values = out[source[a:b]] + logs[a:b]
                alive = values > -np.inf
                if alive.any():
                    self._sums(values[alive], target[a:b][alive], out)
        return out

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability."""
        if not words:
            return np.zeros(0)
        lengths, first, _, _, starts, ends, _, logs = self._edges(words)
        alpha = self._walk(lengths, first, starts, ends, logs, True)
        return alpha[first + np.arange(len(words)) + lengths]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece if word k occurs ``times[k]`` times."""
        out = np.zeros(len(self.log_p))
        if not words:
            return out
        lengths, first, codes, which, starts, ends, pieces, logs = self._edges(words)
        alpha = self._walk(lengths, first, starts, ends, logs, True)
        beta = self._walk(lengths, first, starts, ends, logs, False)
        word = np.repeat(np.arange(len(lengths)), lengths)[starts]
        total = alpha[first + np.arange(len(words)) + lengths]
        with np.errstate(invalid="ignore"):
            used = np.exp(alpha[starts + word] + logs + beta[ends + word] - total[word]) * times[word]
        used = np.nan_to_num(used)
        own = pieces >= 0
        out += np.bincount(pieces[own], used[own], len(out))
        for code, n in zip(codes, np.bincount(which, used[~own], len(codes))):
            for b in chr(code).encode():
                out[b] += n
        return out


def read_pieces(model: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without bytes, control and unknown symbols."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]
    return pieces if any(p == MARK for p, _ in pieces) else [*pieces, (MARK, min(s for _, s in pieces))]


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def blocks_of(docs: DataFrame, doc_id: str, text: str, modulus: int, block_tokens: int) -> DataFrame:
    """One row per block: its documents, their words as numbers into the block's words, most frequent first."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id, modulus).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )

    def block(docs: list[tuple], tokens: list[np.ndarray], words: dict[bytes, int], id_type) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in tokens], np.int32)
        numbers = np.concatenate(tokens)
        train = np.repeat(np.array([not held for _, held in docs]), lengths)
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        numbers = place[numbers]
        texts = list(words)
        columns = {
            "block": pa.array([uuid.uuid4().bytes], pa.binary()),
            "doc_ids": pa.array([[d for d, _ in docs]], pa.list_(id_type)),
            "held": pa.array([[h for _, h in docs]], pa.list_(pa.bool_())),
            "lengths": pa.array([lengths], pa.list_(pa.int32())),
            # The bytes of the numbers by significance: the upper ones are mostly 0.
            "numbers": pa.array([zlib.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)], pa.binary()),
            "words": pa.array([[texts[k].decode() for k in order]], pa.list_(pa.string())),
            "times": pa.array([np.bincount(numbers[train], minlength=len(words))], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens, words, size, id_type = [], [], _Numbers(), 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            ids, held = batch["doc_id"].to_pylist(), batch["held_out"].to_pylist()
            for k in range(len(ids)):
                found = batch["text"][k].as_py().encode().lower().split()
                docs.append((ids[k], held[k]))
                tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
                size += len(found) + 1
                if size >= block_tokens:
                    yield block(docs, tokens, words, id_type)
                    docs, tokens, words, size = [], [], _Numbers(), 0
        if docs:
            yield block(docs, tokens, words, id_type)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        cut,
        f"block binary, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, numbers binary, words array<string>, times array<long>",
    )


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose words have about POINTS_TOGETHER code points."""
    points = np.cumsum(pa.compute.utf8_length(batch["word"]).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        reach = (points[at - 1] if at else 0) + POINTS_TOGETHER
        end = max(at + 1, int(np.searchsorted(points, reach, "right")))
        yield batch.slice(at, end - at)
        at = end


def _fitted(spark: SparkSession, words: DataFrame, lattice: Lattice, documents: int, rounds: int) -> Lattice:
    """Expectation maximisation on (word, times) rows; the driver gets one number per piece and round."""
    prior = lattice
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.value.log_p))
            for batch in batches:
                for part in _parts(batch):
                    total += now.value.expected(part["word"].to_pylist(), part["times"].to_numpy(zero_copy_only=False))
            piece = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], ["piece", "uses"])

        uses = words.where("times > 0").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        counts = np.zeros(len(lattice.log_p))
        for r in uses.collect():
            counts[r["piece"]] = r["uses"]
        counts[-1] = documents
        lattice = lattice.reestimated(counts, prior)
    return lattice


def score(docs: DataFrame, doc_id="doc_id", text="text", model=MODEL, modulus=MODULUS, rounds=ROUNDS, block_tokens=BLOCK_TOKENS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    blocks = written(blocks_of(docs, doc_id, text, modulus, block_tokens), "blocks")
    listed = blocks.select("block", F.posexplode("words").alias("place", "word"), "times").select(
        "block", "place", "word", F.get("times", "place").alias("times")
    )
    words = written(listed.groupBy("word").agg(F.sum("times").alias("times")), "words")
    train_docs = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    seen = words.where("times > 0").agg(F.count(F.lit(1)), F.sum("times")).first()
    train_tokens, vocabulary = (seen[1] or 0) + train_docs, seen[0] + (train_docs > 0)

    lattice = _fitted(spark, words, Lattice.start(read_pieces(model)), train_docs, rounds)
    now = spark.sparkContext.broadcast(lattice)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                logs = now.value.word_logs(part["word"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["word"], part["times"], pa.array(logs)], ["word", "times", "log_p"])

    weighed = written(words.mapInArrow(weigh, "word string, times long, log_p double"), "weighed")
    values = (
        listed.select("block", "place", "word")
        .join(weighed, "word")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("place", "times", "log_p"))).alias("v"))
        .select("block", F.col("v.times").alias("seen"), F.col("v.log_p").alias("log_p"))
    )
    end_log = float(lattice.log_p[-1])
    divisor = train_tokens + vocabulary + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ln10 = np.log(10)
        for batch in batches:
            for k in range(batch.num_rows):
                lengths = batch["lengths"][k].values.to_numpy(zero_copy_only=False)
                raw = zlib.decompress(batch["numbers"][k].as_py())
                numbers = np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
                seen = np.zeros(0, np.int64) if batch["seen"][k].as_py() is None else batch["seen"][k].values.to_numpy(zero_copy_only=False)
                logs = np.zeros(0) if batch["log_p"][k].as_py() is None else batch["log_p"][k].values.to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                known = np.cumsum(np.concatenate([[0], (seen > 0)[numbers] if len(numbers) else []]))[bounds]
                base = _sums_of(np.log10((seen + 1) / divisor), numbers, bounds) + np.log10((train_docs + 1) / divisor)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_ids"][k].values,
                        batch["held"][k].values,
                        pa.array(lengths.astype(np.int64) + 1),
                        pa.array(np.diff(known).astype(np.int64) + int(train_docs > 0)),
                        pa.array(np.full(len(lengths), train_tokens, np.int64)),
                        pa.array(base),
                        pa.array((_sums_of(logs, numbers, bounds) + end_log) / ln10),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = dict(docs.dtypes)[doc_id]
    return (
        blocks.select("block", "doc_ids", "held", "lengths", "numbers")
        .join(values, "block", "left")
        .mapInArrow(
            add_up,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


def _sums_of(by_word: np.ndarray, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each document's words; every document is summed for itself, so none depends on its neighbours."""
    values = by_word[numbers] if len(numbers) else np.zeros(0)
    return np.array([values[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:])])
