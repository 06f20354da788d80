"""Labelled pages to fit the extractor on: generated from page layouts whose parts are known to be text or not."""

from __future__ import annotations

import random

# What marks the parts of a page in class, id or role. Fixed lists of common names.
NAVIGATION = "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip toc".split()
HEAD = "header masthead banner site-header branding logo top hero".split()
FOOT = "footer site-footer bottom colophon copyright legal contentinfo credits".split()
SIDE = "sidebar aside widget related recommended trending popular complementary rail more-stories teaser side side-bar side-column".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adsense adsbygoogle adbox adslot dfp outbrain taboola".split()
NOTICE = "notice cookie cookies consent alert gdpr popup modal overlay dialog warning disclaimer message".split()
FORM = "form login search subscribe newsletter signup register contact".split()
SOCIAL = "share social follow sharing buttons tags meta-links".split()
COMMENT = "comment comments reply replies respond discussion disqus commentlist reader-comments responses thread".split()
TEXT = "article post entry content story body text main article-body post-content entry-content page-content".split()
PLAIN = "container wrapper row col inner box page block section layout".split()

SYLLABLES = "an be co da el fi go ha in jo ka le mo na or pe qua ri so ta un ve wo ya zu".split()


def _words(rng: random.Random, n: int, end: str = "") -> str:
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words).capitalize() + end


def _attributes(rng: random.Random, names: list[str]) -> str:
    name = rng.choice(names)
    if rng.random() < 0.3:
        name += rng.choice([" ", "-"]) + rng.choice(names + PLAIN)
    return f' {rng.choice(["class", "class", "class", "id", "role"])}="{name}"'


def _part(rng: random.Random, tags: list[str], names: list[str], inner: str, bare: float = 0.0) -> str:
    tag = rng.choice(tags)
    return f"<{tag}{'' if rng.random() < bare else _attributes(rng, names)}>{inner}</{tag}>"


def _links(rng: random.Random, n: int) -> str:
    items = [f'<a href="/{k}">{_words(rng, rng.randint(1, 4))}</a>' for k in range(n)]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)


def _paragraph(rng: random.Random, low: int = 1, high: int = 120) -> str:
    n = int(low * (high / low) ** rng.random())
    text = _words(rng, n, rng.choice([".", ".", ".", "!", "?", ":", ""]))
    if n > 8 and rng.random() < 0.3:
        first, _, rest = text.partition(" ")
        text = f'{first} <a href="/x">{rest[: n // 2]}</a>{rest[n // 2 :]}' if rng.random() < 0.5 else f"<b>{text}</b>"
    return text


def _boilerplate(rng: random.Random, kind: str) -> str:
    short = f"<{(t := rng.choice(['p', 'div', 'span']))}>{_paragraph(rng, 1, 40)}</{t}>"
    loose = _paragraph(rng, 1, 40)
    inner = rng.choice([short, loose, short * 2, f"<h{(n := rng.randint(2, 5))}>{_words(rng, 2)}</h{n}>{short}"])
    if kind == "navigation":
        return _part(rng, ["nav"], NAVIGATION, _links(rng, rng.randint(2, 8)), 0.6) if rng.random() < 0.6 else _part(rng, ["div", "ul"], NAVIGATION, _links(rng, 5))
    if kind == "head":
        name = f"<h{(n := rng.randint(1, 3))}>{_words(rng, rng.randint(1, 6))}</h{n}>"
        name = rng.choice([name, name + short, short, name + _links(rng, 3), inner])
        return _part(rng, ["header"], HEAD, name, 0.6) if rng.random() < 0.6 else _part(rng, ["div"], HEAD, name)
    if kind == "foot":
        line = rng.choice(["&copy; ", "Copyright ", ""]) + _words(rng, rng.randint(2, 14), rng.choice(["", "."]))
        line = rng.choice([line, f"<p>{line}</p>", line + _links(rng, 3), f"{line} &middot; {loose}"])
        return _part(rng, ["footer"], FOOT, line, 0.6) if rng.random() < 0.7 else _part(rng, ["div"], FOOT, line)
    if kind == "side":
        side = rng.choice([f"<h3>{_words(rng, 2)}</h3>" + _links(rng, 4), inner, f"<h4>{_words(rng, 3)}</h4>{short}"])
        return _part(rng, ["aside"], SIDE, side, 0.6) if rng.random() < 0.6 else _part(rng, ["div", "section"], SIDE, side)
    if kind == "form":
        form = f'<label>{_words(rng, 3)}</label><input type="text"><button>{_words(rng, 1)}</button>'
        return f"<form>{rng.choice([form, inner + form])}</form>" if rng.random() < 0.6 else _part(rng, ["form", "div"], FORM, inner + form)
    if kind == "comment":
        one = [f"<{(t := rng.choice(['div', 'li', 'article']))}{_attributes(rng, COMMENT)}><p>{_paragraph(rng, 2, 60)}</p></{t}>" for _ in range(rng.randint(1, 4))]
        return _part(rng, ["div", "section", "ol", "ul"], COMMENT, f"<h3>{_words(rng, 2)}</h3>" * (rng.random() < 0.5) + "".join(one))
    names = {"advert": ADVERT, "notice": NOTICE, "social": SOCIAL}[kind]
    if kind == "advert" and rng.random() < 0.2:
        return _part(rng, ["ins"], names, loose)
    if inner == loose:
        return _part(rng, ["div", "section", "p", "span"] if kind == "social" else ["div", "section", "p"], names, inner)
    return _part(rng, ["div", "section"], names, inner)


def _text(rng: random.Random) -> str:
    parts = []
    for _ in range(rng.randint(1, 9)):
        shape = rng.random()
        if shape < 0.75:
            parts.append(f"<p>{_paragraph(rng)}" + "</p>" * (rng.random() < 0.9))
        elif shape < 0.83:
            parts.append(f"<h2>{_words(rng, rng.randint(1, 6))}</h2>")
        elif shape < 0.89:
            parts.append("<ul>" + "".join(f"<li>{_paragraph(rng, 1, 20)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
        elif shape < 0.93:
            parts.append(f"<blockquote>{_paragraph(rng, 5, 40)}</blockquote>")
        elif shape < 0.96:
            parts.append(f"<table><tr><td>{_words(rng, 2)}</td><td>{_words(rng, 1)}</td></tr></table>")
        else:
            parts.append(f"<div>{_paragraph(rng, 4, 80)}</div>")
    return "".join(parts)


def labelled_page(rng: random.Random) -> list[tuple[str, int]]:
    """One page as pieces of HTML in order; 1 where text of the piece belongs to the article."""
    kinds = ["navigation", "head", "notice", "advert", "side", "form", "social"]
    before = [k for k in ("notice", "head", "navigation", "advert", "side", "form") if rng.random() < 0.4]
    after = [k for k in ("social", "comment", "side", "advert", "form", "notice", "foot") if rng.random() < (0.8 if k == "foot" else 0.4)]
    style = rng.random()
    if style < 0.55:
        opens, closes = f"<article{_attributes(rng, TEXT) if rng.random() < 0.3 else ''}>", "</article>"
    elif style < 0.7:
        opens, closes = "<main>", "</main>"
    elif style < 0.9:
        opens, closes = f"<div{_attributes(rng, TEXT)}>", "</div>"
    else:
        opens, closes = "", ""
    if rng.random() < 0.4:
        opens, closes = f"<div{_attributes(rng, PLAIN)}>" + opens, closes + "</div>"
    pieces = [("<!DOCTYPE html><html><head><title>x</title></head><body>", 0)]
    pieces += [(_boilerplate(rng, k), 0) for k in before]
    pieces.append((opens, 0))
    if rng.random() < 0.7:
        title = f"<h1>{_words(rng, rng.randint(2, 12))}</h1>"
        pieces.append((f"<header>{title}</header>" if opens and rng.random() < 0.15 else title, 1))
    pieces.append((_text(rng), 1))
    if opens:
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            pieces.append((_boilerplate(rng, rng.choice([*kinds[2:], "comment", "navigation", "foot"])), 0))
            if rng.random() < 0.7:
                pieces.append((_text(rng), 1))
    pieces.append((closes, 0))
    pieces += [(_boilerplate(rng, k), 0) for k in after]
    return [*pieces, ("</body></html>", 0)]
