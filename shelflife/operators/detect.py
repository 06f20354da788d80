"""Secret detectors over text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelflife.sources.content import SPAN_BYTES


@dataclass(frozen=True)
class Detector:
    """A regex whose group ``group`` is the secret; group 0 is the whole match.

    ``literals`` are texts of which every match contains at least one. They are tested by a plain
    substring search first, so the regex only runs on texts that can match. ``span`` is how many bytes a
    match may cover with what the pattern looks at around it; a detector with ``span=None`` gets every file
    as one text. A match is never empty. With ``min_entropy`` only secrets of at least so many bits per character
    count, which tells random tokens from the words and numbers that look like them.
    """

    category: str
    pattern: str
    literals: tuple[str, ...] = ()
    group: int = 0
    span: int | None = SPAN_BYTES
    min_entropy: float | None = None


@dataclass(frozen=True)
class BatchDetector:
    """A vectorised detector: a function from a pandas Series of texts to a Series of lists of secrets.

    Texts without any of its ``literals``, or without a match of its ``gate``, a regex, stay in the JVM.
    """

    category: str
    find: Callable = field(compare=False, repr=False)
    literals: tuple[str, ...] = ()
    gate: str | None = None


def from_patterns(patterns: dict[str, str], group: int = 0, span: int | None = SPAN_BYTES) -> list[Detector]:
    """A caller's own regexes by category."""
    return [Detector(category, pattern, group=group, span=span) for category, pattern in patterns.items()]


def _token(prefix: str, rest: str) -> str:
    """A token not glued to a word character before it.

    The check looks back from behind the prefix, so it costs nothing until the prefix is met; written in
    front of the prefix it would be tried at every character and make the search ten times slower.
    """
    return f"{prefix}(?<![A-Za-z0-9_]{prefix}){rest}"


# Categories, the prefix of a token and the characters that follow it.
BUILTIN_DETECTORS = (
    Detector("OpenAI/Anthropic API Keys", _token("sk-", "[A-Za-z0-9_-]{20,}"), ("sk-",)),
    Detector(
        "GitHub Tokens",
        _token("gh[oprsu]_", "[A-Za-z0-9]{36,}") + "|" + _token("github_pat_", "[A-Za-z0-9_]{22,}"),
        ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_"),
    ),
    Detector("AWS Keys", _token("AKIA", "[0-9A-Z]{16}"), ("AKIA",)),
    Detector("Slack Tokens", _token("xox[abeprs]-", "[A-Za-z0-9-]{10,}"), ("xox",)),
    Detector("PostHog Keys", _token("ph[cx]_", "[A-Za-z0-9]{30,}"), ("phc_", "phx_")),
)


#: Detectors that are tested one by one.
WIDE = 32
#: Random tokens by alphabet; bits per character a token of its kind has at least.
ENTROPY_DETECTORS = (
    Detector("High-entropy hex", "(?<![0-9A-Za-z+/_-])[0-9a-f]{32,}(?![0-9A-Za-z+/_-])", min_entropy=3.0),
    Detector("High-entropy base64", "(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/]{24,}(?![0-9A-Za-z+/_-])", min_entropy=4.25),
)


def entropy(token: Column) -> Column:
    """Shannon entropy of a string's characters, in bits per character; 0 for an empty one."""
    size = F.length(token)

    def bits(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(token, char, F.lit("")))) / size
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda total, c: F.when(c == "", total).otherwise(bits(total, c)))


def _random_enough(secrets: Column, detector: Detector) -> Column:
    return secrets if detector.min_entropy is None else F.filter(secrets, lambda s: entropy(s) >= detector.min_entropy)


def _can_match(text: Column, detector: Detector | BatchDetector) -> Column:
    """Whether a text holds a literal of the detector.

    A mark that all of several literals share is tested first: the search for it ends at once where it is
    frequent, and saves a search per literal where it does not occur.
    """
    gate = getattr(detector, "gate", None)
    if not detector.literals:
        return text.rlike(gate) if gate else text.isNotNull()
    any_literal = reduce(Column.__or__, [F.contains(text, F.lit(part)) for part in detector.literals])
    marks = sorted(c for c in set.intersection(*map(set, detector.literals)) if not c.isalnum())
    if len(detector.literals) == 1 or not marks:
        return any_literal
    return F.contains(text, F.lit(marks[0])) & any_literal


def _run_batch(find: Callable) -> Callable:
    def run(texts):
        import pandas as pd

        found = pd.Series([[]] * len(texts), index=texts.index, dtype=object)
        present = texts.notna()
        if present.any():
            found[present] = find(texts[present])
        return found

    return run


def matches(text: Column, detector: Detector | BatchDetector) -> Column:
    """All secrets of one detector in a text, in order of appearance."""
    if isinstance(detector, BatchDetector):
        wanted = F.when(_can_match(text, detector), text)
        return F.pandas_udf(_run_batch(detector.find), "array<string>")(wanted)
    found = _random_enough(F.regexp_extract_all(text, F.lit(detector.pattern), F.lit(detector.group)), detector)
    return F.when(_can_match(text, detector), found).otherwise(F.array().cast("array<string>"))


def _all_matches(text: Column, detector: Detector, skip: Column | None) -> Column:
    """All matches of a detector in a text, null where it cannot match; those after the first ``skip`` code points."""
    pattern = F.lit(detector.pattern) if skip is None else _after(detector, skip)
    return F.when(_can_match(text, detector), F.regexp_extract_all(text, pattern, F.lit(0)))


def _after(detector: Detector, skip: Column) -> Column:
    """A pattern whose first match is the first ``skip`` code points, so that the search goes on from behind them.

    What the detector looks back at is still there.
    """
    skipping = F.concat(F.lit(r"\A(?s:.{"), skip.cast("string"), F.lit("})|(?:"), F.lit(detector.pattern), F.lit(")"))
    return F.when(skip > 0, skipping).otherwise(F.lit(detector.pattern))


def _owned(text: Column, detector: Detector, whole: Column, own_from: Column, own_to: Column, skip: Column | None) -> Column:
    """What a search finds in a range of a text, given all its matches: secrets, entry and exit.

    The secrets are those whose match starts in the range. ``entry`` is how far the search was beyond the range's
    start when it came there, ``exit`` how far it was beyond its end when it left. The texts between the matches
    give where each starts; the matches of a range are neighbours, so counting them is enough.
    """
    pattern = F.lit(detector.pattern) if skip is None else _after(detector, skip)
    secrets = whole if detector.group == 0 else F.regexp_extract_all(text, pattern, F.lit(detector.group))
    steps = F.zip_with(F.split(text, pattern, -1), whole, lambda gap, found: F.struct(F.length(gap).alias("gap"), F.length(found).alias("size")))
    zero = F.lit(0)

    def step(state: Column, found: Column) -> Column:
        start = state["at"] + F.coalesce(found["gap"], zero)
        end = start + found["size"]
        early, inside = found["size"].isNotNull() & (start < own_from), found["size"].isNotNull() & (start < own_to)
        return F.struct(
            F.coalesce(end, start).alias("at"),
            (state["early"] + early.cast("int")).alias("early"),
            (state["inside"] + inside.cast("int")).alias("inside"),
            F.when(early, end).otherwise(state["entry"]).alias("entry"),
            F.when(inside, end).otherwise(state["exit"]).alias("exit"),
        )

    def result(state: Column) -> Column:
        own = _random_enough(F.slice(secrets, state["early"] + 1, state["inside"] - state["early"]), detector)
        entry, left = F.greatest(zero, state["entry"] - own_from), F.greatest(zero, state["exit"] - own_to)
        return F.struct(own.alias("secrets"), entry.alias("entry"), left.alias("exit"))

    start = F.struct(zero.alias("at"), zero.alias("early"), zero.alias("inside"), zero.alias("entry"), zero.alias("exit"))
    return F.when(F.size(whole) > 0, F.aggregate(steps, start, step, result))


def matches_any(text: Column, detector: Detector) -> Column:
    """Whether a detector matches anywhere in a text."""
    if detector.min_entropy is not None:
        return F.coalesce(F.size(matches(text, detector)) > 0, F.lit(False))
    return F.coalesce(_can_match(text, detector) & text.rlike(detector.pattern), F.lit(False))


def _unpivot(content: DataFrame, names: Sequence[str], columns: Sequence[Column], value: str) -> DataFrame:
    """One row per item and detector, from one column per detector.

    The columns are computed in a projection of their own, where a text that is itself an expression is
    evaluated once for all detectors.
    """
    keys = [c for c in content.columns if c != "text"]
    wide = content.select(*keys, *[c.alias(f"_{i}") for i, c in enumerate(columns)])
    long = [F.struct(F.lit(n).alias("category"), F.col(f"_{i}").alias(value)) for i, n in enumerate(names)]
    return wide.select(*keys, F.inline(F.array(*long)))


def match_flags(content: DataFrame, detectors: Sequence[Detector] = BUILTIN_DETECTORS) -> DataFrame:
    """One row per item and category with whether the category occurs."""
    flags = [matches_any(F.col("text"), d) for d in detectors]
    return _unpivot(content, [d.category for d in detectors], flags, "matched")


def _one_of(texts: Sequence[str]) -> str:
    """A regex for any of some texts in which those that begin alike share their beginning."""
    tree: dict = {}
    for text in texts:
        node = tree
        for char in text:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [_char(char) + pattern(after) for char, after in sorted(node.items()) if char]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "") if len(ways) > 1 or "" in node else ways[0]

    return pattern(tree)


def _char(char: str) -> str:
    return char if char.isalnum() and char.isascii() else f"\\x{{{ord(char):x}}}"


def _marked(literal: str) -> str:
    """A literal up to its first character of the rarest kind: no letter or digit, else no small letter."""
    kinds = [0 if not c.isalnum() else 1 if c.isupper() or c.isdigit() else 2 for c in literal]
    return literal[: kinds.index(min(kinds)) + 1]


def _wide(content: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """``find_secrets`` for many detectors with literals, at the cost of one search per text.

    The search stops at the rarest characters of the literals only and looks back from there; the detectors of the
    literals it may have met run on the text, their patterns taken from a constant table.
    """
    marked = {part: _marked(part) for d in detectors for part in d.literals}
    keys = sorted(set(marked.values()))
    # Of several that end at one place the shortest is reported, and stands for the longer ones.
    named = {k: [i for i, d in enumerate(detectors) if any(marked[part].endswith(k) for part in d.literals)] for k in keys}
    last = "".join(sorted({_char(k[-1]) for k in keys}))
    present = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(f"[{last}](?<=({_one_of(keys)}))"), F.lit(1)))
    numbers = F.create_map(*(F.lit(x) for k in keys for x in (k, named[k])))
    columns = [c for c in content.columns if c != "text"]
    wanted = F.array_distinct(F.flatten(F.transform(present, lambda k: F.element_at(numbers, k))))
    rows = content.select(*columns, "text", F.explode(wanted).alias("_i"))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_i") + 1)
    found = F.regexp_extract_all("text", of([d.pattern for d in detectors]), of([d.group for d in detectors]))
    return rows.select(*columns, of([d.category for d in detectors]).alias("category"), F.posexplode(found).alias("position", "secret"))


def find_secrets(
    content: DataFrame, detectors: Sequence[Detector | BatchDetector] = BUILTIN_DETECTORS
) -> DataFrame:
    """Scan each text once with every detector: one row per match.

    ``position`` counts the matches of a detector within its text. All columns but ``text`` are carried
    along. The scan needs no shuffle, whatever the size of the content or its hottest root. Of more than ``WIDE``
    detectors those with literals are looked for together.
    """
    many = [d for d in detectors if isinstance(d, Detector) and d.literals and d.min_entropy is None]
    if len(many) > WIDE:
        others = [d for d in detectors if d not in many]
        found = _wide(content, many)
        return found.union(find_secrets(content, others)) if others else found
    keys = [c for c in content.columns if c != "text"]
    text = F.col("text")
    found = [matches(text, d) for d in detectors]
    return (
        _unpivot(content, [d.category for d in detectors], found, "secrets")
        .where(F.size("secrets") > 0)
        .select(*keys, "category", F.posexplode("secrets").alias("position", "secret"))
    )


FOUND_IN_PARTS = ["dir_name", "item", "part", "detector", "category", "position", "secret", "entry", "exit"]


def find_in_files(content: DataFrame, detectors: Sequence[Detector | BatchDetector], first: int = 0) -> DataFrame:
    """The same for file content that comes in parts: the matches each part owns.

    Rows (dir_name, item, part, detector, category, position, secret, entry, exit), the position within the part and
    the detector by its number from ``first`` on; a row without a category holds as secret why a part could not be
    read. A row without a secret tells how a search entered and left its part, where it did not do so at the
    part's ends.
    """
    text, own = F.col("text"), (F.col("own_from"), F.col("own_to"))
    keys = ["dir_name", "item", "part"]
    # The matches in a projection of their own: only where there are some, their places are looked for.
    whole = [matches(text, d) if isinstance(d, BatchDetector) else _all_matches(text, d, None) for d in detectors]
    searched = content.select(*keys, "text", "own_from", "own_to", "error", *(c.alias(f"_{i}") for i, c in enumerate(whole)))
    alone = lambda secrets: F.struct(secrets.alias("secrets"), F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    found = [
        F.when(F.size(f"_{i}") > 0, alone(F.col(f"_{i}"))) if isinstance(d, BatchDetector) else _owned(text, d, F.col(f"_{i}"), *own, None)
        for i, d in enumerate(detectors)
    ]
    found.append(F.when(F.col("error").isNotNull(), alone(F.array("error"))))
    wide = searched.select(*keys, *[c.alias(f"_{i}") for i, c in enumerate(found)])
    names = [*(F.lit(d.category) for d in detectors), F.lit(None).cast("string")]
    long = [F.struct(F.lit(first + i).alias("detector"), name.alias("category"), F.col(f"_{i}").alias("found")) for i, name in enumerate(names)]
    return _found_rows(wide.select(*keys, F.inline(F.array(*long))), keys)


def _found_rows(per_detector: DataFrame, keys: list[str]) -> DataFrame:
    """One row per secret of ``found``, and one for an entry or exit away from the ends."""
    found, none = F.col("found"), F.lit(None).cast("int")
    row = lambda position, secret, entry, left: F.struct(
        position.alias("position"), secret.alias("secret"), entry.alias("entry"), left.alias("exit")
    )
    secrets = F.transform(found["secrets"], lambda secret, k: row(k, secret, none, none))
    moved = (found["entry"] > 0) | (found["exit"] > 0)
    state = F.array(row(none, F.lit(None).cast("string"), found["entry"], found["exit"]))
    rows = F.when(moved, F.concat(secrets, state)).otherwise(secrets)
    return per_detector.where("found is not null").select(*keys, "detector", "category", F.inline(rows))


def find_again(content: DataFrame, detectors: Sequence[Detector | BatchDetector]) -> DataFrame:
    """The matches of one detector each, ``detector``, in ranges of files that its search enters ``skip`` code points late."""
    keys = [c for c in content.columns if c not in ("text", "own_from", "own_to", "error", "detector", "skip")]
    text, after = F.col("text"), F.col("own_from") + F.col("skip")
    of_own = lambda made: F.coalesce(
        *(F.when(F.col("detector") == i, made(d)) for i, d in enumerate(detectors) if isinstance(d, Detector))
    )
    searched = content.withColumn("_whole", of_own(lambda d: _all_matches(text, d, after)))
    found = of_own(lambda d: _owned(text, d, F.col("_whole"), after, F.col("own_to"), after))
    failed = F.struct(F.array("error").alias("secrets"), F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    category = F.when(F.col("error").isNull(), F.get(F.array(*(F.lit(d.category) for d in detectors)), F.col("detector")))
    named = searched.select(*keys, "detector", category.alias("category"), F.when(F.col("error").isNull(), found).otherwise(failed).alias("found"))
    return _found_rows(named, keys)


def number_positions(findings: DataFrame) -> DataFrame:
    """Findings of parts with ``position`` counted over the whole item; only findings are shuffled."""
    keys = ["dir_name", "item", "category", "detector"]
    counted = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "position")) - 1
    return findings.withColumn("position", counted).drop("part")


def merge_findings(findings: DataFrame) -> DataFrame:
    """Each secret of an item once per category, whichever detectors reported it.

    ``position`` is that of its first report. The one column that is not a key is an integer, so the
    merge is a hash aggregate.
    """
    keys = [c for c in findings.columns if c not in ("position", "detector")]
    return findings.groupBy(*keys).agg(F.min("position").alias("position"))


def shared_categories(detectors: Sequence[Detector | BatchDetector]) -> list[str]:
    """Categories that more than one detector reports."""
    names = [d.category for d in detectors]
    return sorted({n for n in names if names.count(n) > 1})


def merge_shared(findings: DataFrame, detectors: Sequence[Detector | BatchDetector]) -> DataFrame:
    """Merge the reports of categories several detectors have; all others stay as they are."""
    shared = shared_categories(detectors)
    findings = findings.drop("detector")
    if not shared:
        return findings
    several = F.coalesce(F.col("category").isin(shared), F.lit(False))
    return findings.where(~several).unionByName(merge_findings(findings.where(several)))


def scan_with(
    content: DataFrame,
    extra: Sequence[Detector | BatchDetector],
    builtin: Sequence[Detector] = BUILTIN_DETECTORS,
) -> DataFrame:
    """The built-in detectors and the caller's together; a secret that two of one category report counts once."""
    detectors = [*builtin, *extra]
    return merge_shared(find_secrets(content, detectors), detectors)


def summarize(findings: DataFrame, item: str = "item") -> DataFrame:
    """Matches and distinct items per root and category.

    Items are reduced first, on (root, category, item): a root holding most of the findings is spread
    over its items before its counts meet in one place.
    """
    return (
        findings.groupBy("dir_name", "category", item)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("dir_name", "category")
        .agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("items"))
    )


#: Distinct items up to which a sketch is exact, as a power of two; beyond it the standard error is 1 / sqrt of them.
SKETCH_BITS = 12


def summary_sketches(findings: DataFrame, by: Sequence[str] = (), item: str = "item") -> DataFrame:
    """The summary per root, category and ``by`` (a day, a scan) with a sketch of the items instead of their number.

    A row stays small however many items it stands for, and rows of many scans go together without the findings.
    """
    return findings.groupBy("dir_name", "category", *by).agg(
        F.count(F.lit(1)).alias("matches"), F.theta_sketch_agg(item, SKETCH_BITS).alias("items_sketch")
    )


def roll_up(sketches: DataFrame, by: Sequence[str] = ("dir_name", "category")) -> DataFrame:
    """Summaries of several scans, or of several roots, as one: matches in all, and distinct items as estimated."""
    union = F.theta_union_agg("items_sketch", SKETCH_BITS)
    return sketches.groupBy(*by).agg(F.sum("matches").alias("matches"), F.theta_sketch_estimate(union).alias("items"))


def recommend(roots: DataFrame, findings: DataFrame) -> DataFrame:
    """Per root: how many secrets were found, and whether a cleanup is advised."""
    per_root = findings.groupBy("dir_name").agg(F.count(F.lit(1)).alias("matches"))
    return roots.join(per_root, "dir_name", "left").select(
        "dir_name",
        F.coalesce("matches", F.lit(0).cast("bigint")).alias("matches"),
        F.coalesce(F.col("matches") > 0, F.lit(False)).alias("cleanup_advised"),
    )


def items_concerned(items: DataFrame, findings: DataFrame, on: Sequence[str] = ("dir_name", "item")) -> DataFrame:
    """The items that hold at least one finding."""
    return items.join(findings.select(*on).distinct(), list(on), "left_semi")
