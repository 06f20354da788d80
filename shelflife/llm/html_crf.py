"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is parsed into leaf blocks: the runs of text between block-level tags, each with the tags and the class,
id and role words around it. The field has a weight for each feature of a block (ancestor tags, those words,
length, links, sentence end, copyright signs) and for each pair of neighbouring labels. It is fitted on labelled
pages (``TRAINING_PAGES`` generated layouts, a bounded set) and decoded by Viterbi; the blocks labelled as text
are the page's main text, in page order.

Head, scripts, styles, templates, comments in the markup, hidden elements and the controls of forms are never
text; formulas are, but for their sources in other notations. Character references are decoded; white space inside a
block, line breaks included, becomes one space.

Each open element knows what holds for all in it, so a block costs the same however deep it stands, and a page time
in proportion to its length.

Defined cases: a null or empty page, and one without text, gives the empty text; open elements at the end of a cut
page are closed, and a tag that is cut itself is left out; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Collection, Iterable, Iterator
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelflife.llm.html_pages import labelled_page

TRAINING_PAGES = 1500
SEED = 1
STEPS = 200
RATE, SHRINK = 0.1, 0.0002

# Fixed sets of HTML element names by their role.
NEVER = frozenset(
    "head script style template noscript svg iframe select textarea button datalist audio video annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr object canvas math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: An open element of the key ends where one of the value begins.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
        "table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPE = frozenset("article aside blockquote body div footer form header main nav ol section table ul html".split())
#: The elements that end where one of the key begins.
ENDED_BY = {tag: tuple(above for above, tags in ENDS.items() if tag in tags) for tags in ENDS.values() for tag in tags}

HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
PARTS = frozenset("article aside footer form header main nav".split())
TAG = re.compile("<[a-zA-Z/!?]")


class Around(NamedTuple):
    """What holds for all that stands in an element."""

    names: frozenset[str] = frozenset()
    article: bool = False
    #: Of the innermost part that says what it is.
    inner: frozenset[str] = frozenset()

    def within(self, tag: str, words: list[str]) -> Around:
        if tag in ("header", "footer") and self.article:
            names = {f"in:article-{tag}"}
        elif tag not in ("html", "body") and tag not in INLINE:
            names = {f"in:{'h' if re.fullmatch('h[1-6]', tag) else tag}"}
        else:
            names = set()
        names.update(f"word:{w}" for w in words)
        article = self.article or tag in ("article", "main")
        inner = self.inner
        if tag in PARTS or words:
            inner = frozenset([f"inner:{tag if tag in PARTS else 'other'}", *(f"inner word:{w}" for w in words)])
        if names <= self.names and article == self.article and inner == self.inner:
            return self
        return Around(self.names if names <= self.names else self.names | names, article, inner)


class _Blocks(HTMLParser):
    """Collects (text, link code points, what is around). Of class, id and role words those in ``known`` count, if given."""

    def __init__(self, known: Collection[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.known = known
        self.open: list[tuple[str, Around, bool]] = []
        # Where in the list of open elements those of a tag, the scopes and the blocks are.
        self.places: dict[str, list[int]] = {}
        self.scopes, self.outer = [-1], [-1]
        self.blocks: list[tuple[str, int, Around]] = []
        self.text: list[str] = []
        self.above: Around | None = None
        self.linked = self.never = self.links = 0

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.linked, self.above or Around()))
        self.text, self.linked, self.above = [], 0, None

    def _push(self, tag: str, words: list[str], unseen: bool) -> None:
        around = self.open[-1][1] if self.open else Around()
        place = len(self.open)
        self.open.append((tag, around.within(tag, words), unseen))
        for places in self._lists(tag):
            places.append(place)
        self.never += unseen
        self.links += tag == "a"

    def _close_down_to(self, place: int) -> None:
        while len(self.open) > place:
            tag, _, unseen = self.open.pop()
            for places in self._lists(tag):
                places.pop()
            self.never -= unseen
            self.links -= tag == "a"

    def _lists(self, tag: str) -> list[list[int]]:
        return [self.places.setdefault(tag, []), *([self.scopes] if tag in SCOPE else []), *([self.outer] if tag not in INLINE else [])]

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._flush()
        elif tag == "br":
            self.text.append(" ")
        ended = max(map(self._last, ENDED_BY.get(tag, ())), default=-1)
        if ended > self.scopes[-1]:
            self._close_down_to(ended)
        if tag == "body" and self.places.get("head"):
            self._close_down_to(self.places["head"][0])
        if tag not in VOID:
            shown = dict(attrs)
            unseen = tag in NEVER or "hidden" in shown or shown.get("aria-hidden") == "true" or HIDDEN.search(shown.get("style") or "")
            words = re.findall(r"[a-z]+", " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).lower())
            self._push(tag, [w for w in words if self.known is None or w in self.known], bool(unseen))

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        place = self._last(tag)
        if place >= 0 and (tag not in INLINE or place > self.outer[-1]):
            self._close_down_to(place)

    def handle_data(self, data: str) -> None:
        if not self.never:
            self.text.append(data)
            if self.above is None and not data.isspace():
                self.above = self.open[-1][1] if self.open else Around()  # where the block's first word stands
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[tuple[str, int, Around]]:
        self.close()
        self._flush()
        return self.blocks


def leaf_blocks(html: str | None, known: Collection[str] | None = None) -> list[tuple[str, int, Around]]:
    parser, html = _Blocks(known), html or ""
    # Behind the last end of a tag there is no whole one; looking for its end would read to the page's end each time.
    end = html.rfind(">") + 1
    cut = TAG.search(html, end)
    parser.feed(html[: cut.start() if cut else len(html)])
    return parser.finish()


def has_article(blocks: Iterable[tuple]) -> bool:
    """Whether the page marks an article or main part at all."""
    return any(around.article for _, _, around in blocks)


def features(block: tuple[str, int, Around], marked: bool) -> set[str]:
    """The names of what holds for a block; ``marked``: its page marks an article."""
    text, linked, around = block
    found = {"any", *around.names, *around.inner}
    if marked and not around.article:
        found.add("outside")
    words = text.count(" ") + 1
    found.add(f"length:{min(6, words.bit_length())}")
    if text[-1] in ".!?":
        found.add("sentence")
    if 2 * linked > len(text):
        found.add("linked")
    if "©" in text or "copyright" in text.lower():
        found.add("copyright")
    return found


class Field:
    """Weights of a fitted field."""

    def __init__(self, weights: dict[str, float], step: np.ndarray) -> None:
        self.weights = weights
        self.words = {name.split(":")[1] for name in weights if name.startswith(("word:", "inner word:"))}
        #: step[a][b]: weight of label b after label a.
        self.step = step.tolist()

    def labels(self, blocks: list[tuple]) -> list[int]:
        """The most probable labels, by Viterbi; a tie goes to the label 0."""
        (stay, enter), (leave, go_on) = self.step
        best, back, marked = None, [], has_article(blocks)
        for block in blocks:
            own = sum(self.weights.get(name, 0.0) for name in features(block, marked))
            if best is None:
                best = (0.0, own)
                continue
            off, on = best
            from_0, from_1 = int(off + stay < leave + on), int(off + enter < on + go_on)
            back.append((from_0, from_1))
            best = (max(off + stay, on + leave), max(off + enter, on + go_on) + own)
        if best is None:
            return []
        label = int(best[1] > best[0])
        out = [label]
        for choice in reversed(back):
            label = choice[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[list[tuple[str, int]]]) -> Field:
    """Weights by gradient ascent on the likelihood of labelled pages, all pages at once."""
    rows, names = [], {}
    for pieces in pages:
        # A block's label is that of the piece its first code point is from: pieces are parsed with a mark each.
        parser, labels = _Blocks(), []
        for html, label in pieces:
            parser.feed(html)
            parser._flush()
            labels += [label] * (len(parser.blocks) - len(labels))
        blocks = parser.finish()
        labels += [0] * (len(blocks) - len(labels))
        if blocks:
            marked = has_article(blocks)
            rows.append(([features(b, marked) for b in blocks], labels))
    for found, _ in rows:
        for f in found:
            for name in sorted(f):
                names.setdefault(name, len(names))
    n, longest = len(rows), max(len(labels) for _, labels in rows)
    y, here = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for r, (_, labels) in enumerate(rows):
        here[r, : len(labels)] = True
        y[r, : len(labels)] = labels
    # The numbers of each block's features, filled up with one number more that stays without weight.
    blocks = [f for found, _ in rows for f in found]
    x = np.full((len(blocks), max(map(len, blocks))), len(names))
    for k, f in enumerate(blocks):
        x[k, : len(f)] = [names[name] for name in f]
    pairs = here[:, 1:] & here[:, :-1]
    seen = np.array([[np.sum(pairs & (y[:, :-1] == a) & (y[:, 1:] == b)) for b in (0, 1)] for a in (0, 1)])
    # One vector of all weights: features, then label pairs. Steps follow Adam's running means of the slope.
    weight = np.zeros(len(names) + 4)
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    own = np.zeros((n, longest, 2))
    for turn in range(1, STEPS + 1):
        own[here, 1] = np.append(weight[:-4], 0.0)[x].sum(axis=1)
        label_p, pair_p = _marginals(own, weight[-4:].reshape(2, 2), here)
        missing = np.repeat((y - label_p[:, :, 1])[here], x.shape[1])
        by_name = np.bincount(x.ravel(), missing, len(names) + 1)[:-1]
        slope = np.concatenate([by_name, (seen - pair_p).ravel()]) / n - SHRINK * weight
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        weight += RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    step = weight[-4:].reshape(2, 2)
    return Field({name: float(weight[k]) for name, k in names.items()}, step)


def _marginals(own: np.ndarray, step: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every block and expected label pairs, by forward and backward sums."""
    n, longest, _ = own.shape
    ahead, behind = np.zeros_like(own), np.zeros_like(own)
    ahead[:, 0] = own[:, 0]
    for t in range(1, longest):
        sums = np.logaddexp(ahead[:, t - 1, 0, None] + step[0], ahead[:, t - 1, 1, None] + step[1]) + own[:, t]
        ahead[:, t] = np.where(here[:, t, None], sums, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        after = own[:, t + 1] + behind[:, t + 1]
        sums = np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None])
        behind[:, t] = np.where(here[:, t + 1, None], sums, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    label_p = np.exp(ahead + behind - total[:, None, None]) * here[:, :, None]
    joint = ahead[:, :-1, :, None] + step + (own[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return label_p, (np.exp(joint) * (here[:, 1:] & here[:, :-1])[:, :, None, None]).sum((0, 1))


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Field:
    rng = random.Random(seed)
    return fit([labelled_page(rng) for _ in range(pages)])


def main_text(field: Field, html: str | None) -> str:
    blocks = leaf_blocks(html, field.words)
    return "\n".join(text for (text, _, _), label in zip(blocks, field.labels(blocks)) if label)


def extract(pages: DataFrame, page_id="page_id", url="url", html="html", field: Field | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    field = field or trained()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(field, h.as_py()) for h in part["html"]]
                columns = [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
