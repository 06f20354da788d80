"""Chat formatting, nearest neighbours and text extraction against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from shelflife.llm import ann, chat, html_crf, html_pages, queries
from shelflife.llm.common import read_table

SF = "/root/testdata/sf0.001"

# Chats.

TURNS = "conv_id long, turn long, role string, text string"
CLASHING = "turns string, starts int, blocks string, formatted string, t string"


def chats():
    nasty = ["", None, "<|end|>\n", "\\l<\\b>", "a<|next|>b", "<|assistant|>\n", "\\", "é𝄞", "x" * 20_000, "|>", "\n\n"]
    rows = []
    rng = random.Random(2)
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "system", "<r>|", None]), rng.choice(nasty)))
    rows += [(100, None, "user", "no turn"), (100, 0, "assistant", "same turn"), (100, 0, "assistant", "same turn"), (100, 0, "user", "tie")]
    return rows


def in_order(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, chat_escape(r or ""), chat_escape(x or ""), r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in out.items()}


def chat_escape(text):
    return text.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")


def test_chats_read_back(spark):
    rows = chats()
    df = spark.createDataFrame([(*r, None, 1, None, None, None) for r in rows], f"{TURNS}, {CLASHING}").repartition(5)
    found = chat.read_chats(chat.format_chats(df)).collect()
    expected = in_order(rows)
    assert {r["conv_id"] for r in found} == set(expected) and len(found) == len(expected)
    for r in found:
        turns = expected[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(x for role, x in turns if role == "assistant")
        spans = [r["formatted"][s["start"] : s["start"] + s["chars"]] for s in r["loss_spans"]]
        assert spans == [chat_escape(x) for role, x in turns if role == "assistant"]
        # Adjacent turns of one role share a block.
        runs = sum(k == 0 or turns[k][0] != turns[k - 1][0] for k in range(len(turns)))
        assert r["formatted"].count("<|end|>\n") == runs


def test_chats_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_control_conversation(spark):
    row = queries.op7_chat_format(spark, SF).where("conv_id = -7").first()
    text = queries.CONTROL_TEXT
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# Nearest neighbours.


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_turning_keeps_lengths_and_angles():
    rows = ann._unit(np.random.default_rng(1).normal(size=(5, 10)))
    out = ann.turned(rows, 3, 8)
    assert out.shape == (5, 16) and np.allclose(out @ out.T, rows @ rows.T)


def brute_nearest(rows, is_query, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if is_query(q):
            near = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    score = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                    near[i] = max(score, near.get(i, -9))
            out[q] = sorted((-s, i) for i, s in near.items())[:k]
    return out


VECTORS = "vec_id long, embedding array<double>, label int, v string, dim int, cell string, score double"


def test_search_finds_all_with_full_probes(spark, monkeypatch):
    """Every cell probed, tiny blocks: the result is that of brute force, ties and odd rows included."""
    monkeypatch.setattr(ann, "CELL_ROWS", 7)
    monkeypatch.setattr(ann, "CELL_QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(200 + i, [2.0, 4.0, 6.0, 8.0]) for i in range(3)]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 0.0, 0.0]), (304, [1.0, float("nan"), 0.0, 0.0])]
    rows += [(305, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (306, [1.0, 2.0]), (307, [2.0, 1.0]), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, "x", 1, "y", 0.5) for i, v in rows], VECTORS).repartition(4)
    found = ann.search(df, (df["vec_id"] % 4) == 0, probes=8)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    expected = {q: near for q, near in brute_nearest(rows, lambda i: i % 4 == 0, 5).items() if near}
    assert got == expected


def test_every_query_finds_all_there_is(spark):
    """Few vectors, of several dimensions: the probed cells alone would miss some."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(6)] + [(10 + k, rng.normal(size=8).tolist()) for k in range(3)]
    rows += [(20, [1.0, 2.0]), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df["vec_id"] >= 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: len(n) for q, n in found.items()} == {**{k: 5 for k in range(6)}, 10: 2, 11: 2, 12: 2}
    for q, near in found.items():
        own = [np.array(v) for i, v in rows if i == q]
        best = {}
        for i, v in rows:
            for o in own:
                if i != q and len(v) == len(o):
                    best[i] = max(best.get(i, -2), float(np.dot(o, v) / np.sqrt(np.dot(o, o) * np.dot(v, v))))
        assert [i for _, i, _ in sorted(near)] == sorted(best, key=lambda i: (-best[i], i))[:5]


def test_recall(spark):
    rows = read_table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    expected = brute_nearest([tuple(r) for r in rows], lambda i: i % 50 == 0, 5)
    found = queries.op8_ann_cross_polytope(spark, SF).collect()
    hits = sum((-r["score"], r["vec_id"]) in expected[r["query_id"]] for r in found)
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_search_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none["vec_id"] % 2 == 0).collect() == []


# Text extraction.


@pytest.fixture(scope="module")
def field():
    return html_crf.trained()


def test_viterbi_equals_enumeration(field):
    blocks = html_crf.leaf_blocks("<nav><a>x</a></nav><p>A b c.</p><div class=ad>buy</div><article><p>Long text here.</p></article><footer>c</footer>")
    marked = html_crf.has_article(blocks)
    own = [sum(field.weights.get(n, 0) for n in html_crf.features(b, marked)) for b in blocks]

    def value(labels):
        return sum(o for o, y in zip(own, labels) if y) + sum(field.step[a][b] for a, b in zip(labels, labels[1:]))

    every = [[(k >> j) & 1 for j in range(len(blocks))] for k in range(1 << len(blocks))]
    assert value(field.labels(blocks)) == pytest.approx(max(map(value, every)))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    own, step = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    here = np.array([[True, True, True, False]])
    weights = {}
    for k in range(8):
        y = [(k >> j) & 1 for j in range(3)]
        weights[tuple(y)] = math.exp(sum(own[0, j, y[j]] for j in range(3)) + step[y[0], y[1]] + step[y[1], y[2]])
    total = sum(weights.values())
    label_p, pair_p = html_crf._marginals(own, step, here)
    for j in range(3):
        assert label_p[0, j, 1] == pytest.approx(sum(w for y, w in weights.items() if y[j]) / total)
    assert pair_p[0, 1] == pytest.approx(sum(w * ((y[0], y[1]) == (0, 1)) + w * ((y[1], y[2]) == (0, 1)) for y, w in weights.items()) / total)


def test_held_out_layouts(field):
    rng, wrong, blocks = random.Random(99), 0, 0
    for _ in range(300):
        parser, labels = html_crf._Blocks(), []
        for html, label in html_pages.labelled_page(rng):
            parser.feed(html)
            parser._flush()
            labels += [label] * (len(parser.blocks) - len(labels))
        found = parser.finish()
        wrong += sum(a != b for a, b in zip(field.labels(found), labels))
        blocks += len(found)
    assert wrong <= 0.01 * blocks


PAGES = {
    "<html><body><div class='site-header'><a href='/'>Home</a></div><h1>A title</h1><p>A first paragraph, long enough.</p><p>Second.</p>"
    "<div class='comments'><p>nice post!</p></div><div id='footer'>Copyright 2020</div>": "A title\nA first paragraph, long enough.\nSecond.",
    "<body><header><h1>Site</h1><nav><a href=a>A</a></nav></header><main><article><h1>T</h1><p>One&nbsp;two &lt;b&gt;\n<br> three&amp.</p>"
    "<aside><p>Related things.</p></aside><div class='ad'>Buy now!</div><p>More <b>text</b>.<script>var x='</p>'</script></p><form><label>Mail"
    "</label><input></form><section id='comments'><article class='comment'><p>I like this, thanks.</p></article></section></article></main>"
    "<footer>&copy; X</footer>": "T\nOne two <b> three&.\nMore text.",
    "<div class='cookie-notice'>We use cookies.</div><article><p>Hi.<p>Cut page, still ope": "Hi.\nCut page, still ope",
    "": "",
    "<!-- nothing --><script>x": "",
}


def test_pages(spark, field):
    rows = [(k, None, html, k, "x", "y") for k, html in enumerate([*PAGES, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string, label string")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_crf.extract(df, field=field).collect()}
    assert found == {k: (t, len(t)) for k, t in enumerate([*PAGES.values(), ""])}
    assert html_crf.extract(df.limit(0), field=field).collect() == []


def test_driver_pages(spark, field):
    """Pages that mark their article: the text is that of the article's parts."""
    import html

    for r in html_crf.extract(read_table(spark, SF, "pages"), field=field).join(read_table(spark, SF, "pages"), ["page_id", "url"]).collect():
        article = re.search(r"(?s)<article>(.*)</article>", r["html"])
        parts = re.split(r"</?(?:h1|p)>", article[1] if article else "")
        clean = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        assert r["text"] == "\n".join(p for p in clean if p)


def test_very_long_page(field):
    html = "<article>" + "<p>word another.</p>" * 20_000 + "</article>"
    assert html_crf.main_text(field, html).count("\n") == 19_999


def test_formulas_are_text(field):
    html = "<article><p>The formula <math><semantics><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow><annotation>a+b</annotation></semantics></math> is known to all.</p></article>"
    assert [b[0] for b in html_crf.leaf_blocks(html)] == ["The formula a+b is known to all."]


@pytest.mark.parametrize("tag", ["<div>", "<font>", "<a x ", "<p><b>", "<ul><li>", "<div class='c{0} x'>", "<table><tr><td>", "</b>", "<main><header>"])
def test_deep_pages_take_time_in_proportion(field, tag):
    import time

    def seconds(n):
        html = "".join(tag.format(k) + ("word " if k % 3 == 0 else "") for k in range(n)) + "<p>The last words of a page.</p>"
        start = time.perf_counter()
        html_crf.main_text(field, html)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 2.5 * seconds(16_000) + 0.3
