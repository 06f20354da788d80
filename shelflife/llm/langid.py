"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot j holds a mask with a bit for each language, so looking up an
n-gram's slots and AND-ing their masks returns all languages whose filter contains it. A language's popcount
over a text is corrected for the false positives its filter is known to give; the largest corrected count
decides. The score is its share of all corrected counts times the share of the text's distinct n-grams that the
language holds, corrected likewise.

A language is recognised only if it holds ``FLOOR`` of the distinct n-grams, and so many that its filter would
claim them by chance in fewer than ``ALPHA`` of all texts; else the score is 0. Distinct n-grams, since a
repeated one is one draw of the filter, however often it stands there.

Filters are fitted on labelled documents: of each language about ``SAMPLE_DOCS``, chosen by a hash of the id,
and of those the ``NGRAMS`` most frequent n-grams that the language uses often against the others. The fitted
state is bounded by these parameters; every text is classified in full.

N-grams are 3 to 5 code points of the lower-cased text, where all that is no letter counts as a space and no
space stands inside.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a text none of whose n-grams is
known gets the language with most labelled documents and score 0, one that is not recognised the language that
holds most and score 0; ties go to the smaller language code; without any labelled document everything is ``und``; repeated rows are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shelflife.llm.common import held_out

SIZES = (3, 4, 5)
SAMPLE_DOCS = 2000
NGRAMS = 20_000
SLOTS = 1 << 18
HASHES = 2
#: A language contains an n-gram if it has this share of the n-gram's rates over all languages.
SHARE = 0.4
#: The least corrected share of a text's distinct n-grams that a recognised language holds.
FLOOR = 0.2
#: A bound on how often a text whose n-grams no filter holds is recognised; only short texts come near it.
ALPHA = 0.02
#: Code points looked at together; longer texts are looked at in parts whose n-grams overlap.
PART = 1 << 19
UNKNOWN = "und"
HELD_OUT_MODULUS = 4


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _parts(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of (text number, part, windows that start in it), together about PART code points."""
    group, size, reach = [], 0, max(SIZES) - 1
    for k, text in enumerate(texts):
        text = text.lower()
        for at in range(0, len(text), PART):
            part = text[at : at + PART + reach]
            group.append((k, part, min(PART, len(text) - at)))
            size += len(part)
            if size >= PART:
                yield group
                group, size = [], 0
    if group:
        yield group


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of the texts and the numbers of the texts they are from, part by part."""
    for group in _parts(texts):
        # Every part stands between spaces, so that n-grams reach word ends and no two parts join.
        joined = " ".join(["", *(part for _, part, _ in group), ""]) + " " * max(SIZES)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        space = ~_letters()[points]
        code = np.where(space, np.uint32(32), points).astype(np.uint64)
        lengths = np.array([len(part) + 1 for _, part, _ in group])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        # A window counts for the part it starts in; the first begins at the space in front.
        owner = np.full(len(points), -1, np.int64)
        for (k, part, count), start in zip(group, starts):
            owner[start : start + (count + 1 if count == len(part) else count)] = k
        n_max = len(points) - max(SIZES)
        hashed = code[:n_max].copy()
        inside = np.zeros(n_max, bool)
        for n in range(2, max(SIZES) + 1):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 : n - 1 + n_max]
            if n > 2:
                inside |= space[n - 2 : n - 2 + n_max]
            if n in SIZES:
                keep = np.flatnonzero(~inside & (owner[:n_max] >= 0))
                mixed = hashed[keep] + np.uint64(n)
                mixed ^= mixed >> np.uint64(32)
                mixed *= np.uint64(0xD6E8FEB86659FD93)
                mixed ^= mixed >> np.uint64(32)
                yield mixed, owner[keep]


def _distinct(hashed: np.ndarray, owner: np.ndarray, seen: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct n-grams of each text, their texts, how often they stand there, and whether no earlier part had them.

    ``owner`` is ascending. ``seen`` holds what the earlier parts of the texts in it had and is brought up to date.
    """
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ordered = hashed.copy()
    for at, end in zip(starts, [*starts[1:], len(ordered)]):
        ordered[at:end].sort()
    first = np.ones(len(ordered), bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (owner[1:] != owner[:-1])
    firsts = np.flatnonzero(first)
    values, owner = ordered[firsts], owner[firsts]
    times = np.diff(firsts, append=len(ordered)).astype(float)
    fresh = np.ones(len(values), bool)
    for k in seen:
        at, end = np.searchsorted(owner, [k, k + 1])
        if at < end:
            fresh[at:end] = ~np.isin(values[at:end], seen[k])
            seen[k] = np.concatenate([seen[k], values[at:end][fresh[at:end]]])
    return values, owner, times, fresh


def _slots(hashed: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((hashed >> np.uint64(20 * k)) % np.uint64(slots)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    languages: list[str]
    #: One row of masks for each 64 languages.
    masks: np.ndarray
    #: By language, how often its filter claims an n-gram it does not hold.
    false_positive: np.ndarray
    fallback: str

    def classify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts, held = np.zeros((2, len(self.languages), len(texts)))
        total, distinct = np.zeros((2, len(texts)))
        slots = self.masks.shape[1]
        # Lower case may be longer than the text, so texts that may have parts are remembered generously.
        seen = {k: np.zeros(0, np.uint64) for k, text in enumerate(texts) if len(text or "") > PART // 4}
        for hashed, owner in ngrams([t or "" for t in texts]):
            hashed, owner, times, fresh = _distinct(hashed, owner, seen)
            total += np.bincount(owner, times, len(texts))
            distinct += np.bincount(owner[fresh], minlength=len(texts))
            places = list(_slots(hashed, slots))
            for word, row in enumerate(self.masks):
                found = row[places[0]]
                for place in places[1:]:
                    found &= row[place]
                for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hit = (found >> np.uint64(k % 64)) & np.uint64(1) != 0
                    counts[k] += np.bincount(owner[hit], times[hit], len(texts))
                    held[k] += np.bincount(owner[hit & fresh], minlength=len(texts))
        wrong = self.false_positive[:, None]
        true = np.maximum(0.0, (counts - total * wrong) / (1 - wrong))
        out = []
        for k, text in enumerate(texts):
            if not self.languages or not any(map(str.isalpha, text or "")):
                out.append((UNKNOWN, 0.0))
                continue
            best, all_of = int(np.argmax(true[:, k])), float(true[:, k].sum())
            known = self._known(best, float(held[best, k]), float(distinct[k]))
            out.append((self.languages[best], float(true[best, k]) / all_of * known) if all_of > 0 else (self.fallback, 0.0))
        return out

    def _known(self, language: int, held: float, distinct: float) -> float:
        """The corrected share of a text's distinct n-grams that a language holds, 0 if that does not recognise it."""
        wrong = float(self.false_positive[language])
        share = held / distinct
        known = (share - wrong) / (1 - wrong) if share > wrong else 0.0
        if known < FLOOR:
            return 0.0
        # Chernoff's bound on the chance of so many false positives, for the best of all languages.
        evidence = held * math.log(share / wrong)
        if held < distinct:
            evidence += (distinct - held) * math.log((1 - share) / (1 - wrong))
        return known if evidence >= math.log(len(self.languages) / ALPHA) else 0.0


def fit(docs: DataFrame, text="text", lang="lang", sample_key="doc_id", sample_docs=SAMPLE_DOCS, n_grams=NGRAMS, slots=SLOTS) -> Filters:
    """Filters from the labelled rows of ``docs``. ``sample_key`` only chooses the rows that are fitted on."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.lit(2), F.col(sample_key)), F.lit(1 << 30)).alias("key")
    )
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(per_lang)
    if not languages:
        return Filters([], np.zeros((1, slots), np.uint64), np.zeros(0), UNKNOWN)
    shares = docs.sparkSession.createDataFrame(
        [(code, int(min(1.0, sample_docs / n) * (1 << 30))) for code, n in per_lang.items()], "lang string, below long"
    )
    sample = labelled.join(F.broadcast(shares), "lang").where(F.col("key") < F.col("below")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = batch["text"].to_pylist(), batch["lang"].to_pylist()
            for code in sorted(set(codes)):
                own = [t for t, c in zip(texts, codes) if c == code]
                found = [h for h, _ in ngrams(own)]
                hashed, times = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                columns = [pa.array([code] * len(hashed), pa.string()), pa.array(hashed.view(np.int64)), pa.array(times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "ngram", "times"])

    counts = sample.mapInArrow(count, "lang string, ngram long, times long").groupBy("lang", "ngram").agg(F.sum("times").alias("times"))
    totals = counts.groupBy("lang").agg(F.sum("times").alias("total"))
    rates = counts.where("times > 1").join(F.broadcast(totals), "lang").withColumn("rate", F.col("times") / F.col("total"))
    held = (
        rates.groupBy("ngram")
        .agg(F.collect_list(F.struct("lang", "rate", "times")).alias("uses"), F.sum("rate").alias("all_rates"))
        .select("ngram", "all_rates", F.inline("uses"))
        .where(F.col("rate") >= SHARE * F.col("all_rates"))
    )
    masks = np.zeros((-(-len(languages) // 64), slots), np.uint64)
    often = Window.partitionBy("lang").orderBy(F.col("times").desc(), "ngram")
    top = held.withColumn("place", F.row_number().over(often)).where(F.col("place") <= n_grams).select("lang", "ngram").collect()
    for k, code in enumerate(languages):
        hashed = np.array([r["ngram"] for r in top if r["lang"] == code], np.int64).view(np.uint64)
        for place in _slots(hashed, slots):
            masks[k // 64, place] |= np.uint64(1) << np.uint64(k % 64)
    fill = np.array([np.count_nonzero(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / slots for k in range(len(languages))])
    return Filters(languages, masks, fill**HASHES, max(languages, key=lambda code: (per_lang[code], code)))


def identify(docs: DataFrame, filters: Filters, text="text", names=("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score in columns of these ``names``; the text alone decides."""
    pred, score = names
    kept = docs.drop(pred, score)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = filters.classify(batch[text].to_pylist())
            codes, scores = pa.array([code for code, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), codes, scores], [*columns, pred, score])

    columns = kept.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(classify, ", ".join([*fields, f"{pred} string", f"{score} double"]))


def trained(docs: DataFrame, doc_id="doc_id", text="text", lang="lang") -> Filters:
    """Filters fitted on the documents that are not held out."""
    return fit(docs.where(~held_out(doc_id, HELD_OUT_MODULUS)), text, lang, doc_id)
