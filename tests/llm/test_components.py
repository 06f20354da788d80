"""Components of links, and what the comparison of near-duplicates ships."""

from __future__ import annotations

import random

import pytest

from shelflife.llm import components, neardup


def plain(links):
    """The least key of each linked key's component, found by spreading it until nothing changes."""
    least = {k: k for link in links for k in link}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


@pytest.fixture
def rounds(monkeypatch):
    """Rounds written."""
    found, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, purpose: found.append(purpose) or real(df, purpose))
    return found


def found(spark, links):
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len({r["key"] for r in rows})
    return {r["key"]: r["root"] for r in rows}


def test_components_of_chains_rings_and_trees(spark, rounds):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 400)
    links = [(names[k], names[k + 1]) for k in range(60)] + [(names[100 + k], names[100 + (k + 1) % 30]) for k in range(30)]
    links += [(names[200 + k], names[200 + rng.randrange(k)]) for k in range(1, 150)] + [(names[399], names[398])] * 2 + [(names[390], names[390])] + [(names[390], names[391])]
    assert found(spark, links) == plain(links)
    assert len(rounds) <= 8


def test_stars_take_one_round(spark, rounds):
    """Around their least, their greatest or any key: a round that changes nothing is not needed to see the end."""
    links = [(0, k) for k in range(1, 30)] + [(k, 99) for k in range(50, 90)] + [(150, k) for k in range(140, 160) if k != 150]
    assert found(spark, links) == plain(links)
    assert rounds == ["links"]


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_of_the_top_are_shipped_to_the_others_only(spark, monkeypatch):
    """Classes of one component are not compared with each other, so they do not meet, however many there are."""
    monkeypatch.setattr(neardup, "BLOCK_VALUES", 1000)
    top, key = b"t" * 16, lambda k: k.to_bytes(16, "big")
    rows = [(top, key(k), 100, top) for k in range(400)] + [(top, key(1000 + k), 100, key(1000 + k)) for k in range(25)]
    met = neardup._meetings(spark.createDataFrame(rows, "top binary, key binary, n long, root binary")).collect()
    groups, block = {}, {}
    for r in met:
        block[bytes(r["key"])] = r["block"]
        for g in r["meet"]:
            groups.setdefault((g["low"], g["high"]), set()).add(bytes(r["key"]))
    assert len(block) == 425 and sum(map(len, groups.values())) == 400 * 3 + 25 * (3 + 40)
    others = [key(1000 + k) for k in range(25)]
    for x in others:  # every other class meets every class once, but for its own block, which is one group
        assert all(sum(x in g and y in g for g in groups.values()) >= 1 for y in block)
        assert all(sum(x in g and key(k) in g for g in groups.values()) == 1 for k in range(400))
    assert not spark.createDataFrame(rows[:400], "top binary, key binary, n long, root binary").transform(neardup._meetings).collect()
