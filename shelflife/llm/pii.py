"""Personal data by patterns, checksums and context, in SQL functions only.

A regular expression per kind proposes spans, leftmost and non-overlapping within the kind. A validator drops
the ones that fail: octets at most 255, Luhn, digit counts, mod-97 for account numbers. An account number in
print form may be followed by words that look like its groups, so it ends where it passes. What is left has the
kind's score, raised by a context word of the kind nearby. The four base kinds are always kept; the added kinds
(iban, ssn) need a score of ``THRESHOLD``.

Offsets are code points of the whole text, the end exclusive. Patterns are written so that no run of text is
scanned again from each of its characters and no repeated group recurses; hits are collected in blocks, and what
stands around them is read from pieces of the text. So very long texts, and texts with very many hits, cost linear
time.

Defined cases: a null text is the empty text and has no spans; repeated rows are rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelflife.llm.common import chunks, collect_over, cut, let

THRESHOLD = 0.5
BEFORE, AFTER = 48, 24
CONTEXT = 0.25


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    small = lambda part: F.regexp_replace(part, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    return F.forall(F.split(hit, r"\."), small)


def luhn(digits: Column) -> Column:
    backwards = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    )
    return F.aggregate(F.transform(backwards, value), F.lit(0), lambda a, d: a + d) % 10 == 0


def _card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.length(digits).between(12, 19) & luhn(F.substr(digits, F.lit(1), F.lit(19)))


def _phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def mod97(hit: Column) -> Column:
    """Whether an account number in print form leaves remainder 1, its first four characters moved to the end."""
    compact = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    step = lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


#: Code points of an account number without spaces, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_length(hit: Column) -> Column:
    """Code points of the account number a hit begins with, null if none.

    Of the prefixes that end at a space, and the whole hit, that pass mod-97: the one with the length of its
    country, else the whole hit, else, if the country is not listed, the longest.
    """
    prefix = lambda end: F.substr(hit, F.lit(1), end)
    compact = lambda end: F.length(F.replace(prefix(end), F.lit(" "), F.lit("")))
    lengths = F.create_map(*(F.lit(x) for n, codes in IBAN_LENGTHS.items() for code in codes.split() for x in (code, n)))
    of_country = F.try_element_at(lengths, prefix(F.lit(2)))
    # Groups of four and a space each.
    inner = F.filter(F.array(*(F.lit(5 * n - 1) for n in range(8, 3, -1))), lambda end: F.substr(hit, end + 1, F.lit(1)) == " ")
    ends = F.filter(F.concat(F.array(F.length(hit)), inner), lambda end: mod97(prefix(end)))
    exact = F.filter(ends, lambda end: compact(end) == of_country)
    other = F.filter(ends, lambda end: (end == F.length(hit)) | of_country.isNull())
    return F.coalesce(F.get(exact, F.lit(0)), F.get(other, F.lit(0)))


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap test that any text with a span passes.
    needs: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    #: Code points of a hit that are the span, null for none.
    extent: Callable[[Column], Column] = F.length
    #: If set, a hit is the first group of the pattern, and so many code points on the next may begin.
    head: int | None = None


#: In the order in which spans with the same start are listed.
KINDS = (
    Kind(
        "email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda hit: F.lit(True), 0.7, "mail|contact|write to|kontakt|courriel|correo",
    ),
    Kind(
        "ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        _octets, 0.5, r"\bip\b|address|server|host|adresse|dirección",
    ),
    Kind(
        "card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++",
        _card, 0.7, "card|visa|master|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
        _phone, 0.6, "phone|tel|call|mobil|fax|telefon|teléfono",
    ),
    Kind(
        "iban", r"[A-Z]{2}[0-9]{2}",
        r"\b(?=([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9])){2,7}+(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?)(?![A-Za-z0-9])))"
        r"[A-Z]{2}[0-9]{2}",
        lambda hit: F.lit(True), 0.6, "iban|account|bank|konto|compte|cuenta", base=False, extent=iban_length, head=4,
    ),
    Kind(
        "ssn", r"[0-9]-[0-9]",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        lambda hit: F.lit(True), 0.3, r"\bssn\b|social security", base=False,
    ),
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _found(text: Column, rank: int, kind: Kind) -> Column:
    """The valid spans of a kind. The pieces between the hits and the hits themselves give the offsets."""
    pieces = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1 if kind.head else 0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
    )

    def walk(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        size = F.when(kind.valid(piece["hit"]), kind.extent(piece["hit"]))
        past = start + F.when(piece["hit"].isNull(), 0).otherwise(F.lit(kind.head) if kind.head else F.length(piece["hit"]))
        keep = piece["hit"].isNotNull() & size.isNotNull()
        if kind.head:
            keep = keep & (state["last"] <= start)
        span = F.struct(start.alias("start"), (start + size).alias("end"))
        return F.struct(
            past.alias("at"),
            F.when(keep, start + size).otherwise(state["last"]).alias("last"),
            F.when(keep, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    offsets = collect_over(pieces, {"at": F.lit(0), "last": F.lit(0)}, walk, "struct<start:int,end:int>")

    def scored(found: Column, parts: Column) -> Column:
        def near(s: Column) -> Column:
            before = F.least(s["start"], F.lit(BEFORE))
            return F.lower(F.concat(cut(parts, s["start"] - before, before), F.lit(" "), cut(parts, s["end"], F.lit(AFTER))))

        spans = F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind.name).alias("kind"),
                s["end"].alias("end"),
                (F.lit(kind.score) + F.when(near(s).rlike(kind.context), CONTEXT).otherwise(0.0)).alias("score"),
            ),
        )
        return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    none = F.array().cast(SPAN)
    spans = let(offsets, lambda found: F.when(F.size(found) > 0, let(chunks(text), lambda parts: scored(found, parts))).otherwise(none))
    return F.when(text.rlike(kind.needs), spans).otherwise(none)


def find_spans(text: Column) -> Column:
    """All spans of a text by start, then kind: array of (start, rank, kind, end, score)."""
    # A text without a digit or an at sign has no span; most texts end here.
    found = F.sort_array(F.concat(*(_found(text, rank, kind) for rank, kind in enumerate(KINDS))))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast(SPAN))


def detect(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """Per document: doc_id and ``pii``, its spans."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.select("doc_id", find_spans(F.col("text")).alias("pii"))


def redacted(text: Column) -> Column:
    """The spans that ``find_spans`` reports, those that overlap as one named after the first: start, end, kind."""
    kind = "struct<start:int,end:int,kind:string>"

    def merge(state: Column, s: Column) -> Column:
        last, own = state["last"], F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        over = last.isNotNull() & (last["end"] > s["start"])
        return F.struct(
            F.when(over, grown).otherwise(own).cast(kind).alias("last"),
            F.when(over | last.isNull(), state["out"]).otherwise(F.array_append(state["out"], last)).alias("out"),
        )

    finish = lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["last"]))
    none = F.array().cast(f"array<{kind}>")
    merged = lambda spans: collect_over(spans, {"last": F.lit(None).cast(kind)}, merge, kind, finish)
    return let(find_spans(text), lambda spans: F.when(F.size(spans) > 0, merged(spans)).otherwise(none))


def redact(docs: DataFrame, text="text") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by their kind in brackets; null stays null."""
    whole = F.col(text)

    def clean(spans: Column, parts: Column) -> Column:
        end_before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        pieces = F.transform(
            spans,
            lambda s, i: F.concat(cut(parts, end_before(i), s["start"] - end_before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")),
        )
        end = F.get(spans, F.size(spans) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), cut(parts, end, F.length(whole) - end))

    found = let(
        redacted(whole),
        lambda spans: F.when(F.size(spans) > 0, let(chunks(whole), lambda parts: clean(spans, parts))).otherwise(whole),
    )
    return docs.withColumn(text, F.when(whole.isNotNull(), found))
