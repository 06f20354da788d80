"""SimHash near-duplicates against a plain statement of the rule."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from shelflife.llm import queries, simhash
from shelflife.llm.common import read_table

SF = "/root/testdata/sf0.01"
WHITE = "\t\n\x0b\x0c\r "


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c not in WHITE:
            word += c
        elif word:
            words.append(word)
            word = ""
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints, ids):
    """The least id each row reaches, rows compared one with all."""
    fps, parent = np.array(fingerprints, np.uint64), list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ids)):
        for y in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 3):
            parent[find(x)] = find(int(y))
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [least.get(find(x)) for x in range(len(ids))]


def as_rows(found):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()), key=str)


def expected(rows):
    fps = [plain_fingerprint(text) for _, text in rows]
    return sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, plain_components(fps, [i for i, _ in rows]))), key=str)


def test_query_equals_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    assert as_rows(queries.QUERIES["op11_simhash_neardup"](spark, SF)) == expected([tuple(r) for r in docs])


def test_odd_rows(spark, odd):
    assert as_rows(simhash.near_duplicates(odd)) == expected([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_no_rows(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "A b  c d"), (None, "x y z q"), (5, "x y z q"), (None, None)], "doc_id long, text string")
    assert sorted((r["component_id"] for r in simhash.near_duplicates(docs).collect()), key=str) == [5, 5, None, None, None]


def test_step_does_not_matter(monkeypatch):
    text = " ".join(f"w{k * k % 977}" for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


def planted(rng, groups, size, flips):
    """Fingerprints around common centres, and as many of their own."""
    found = []
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            own = centre
            for k in rng.sample(range(64), rng.randint(0, flips)):
                own ^= 1 << k
            found.append(own)
        found += [rng.getrandbits(64) for _ in range(size)]
    return sorted(set(found))


@pytest.mark.parametrize("bucket, group", [(2048, 1 << 14), (100, 1 << 12)])
def test_buckets_dealt_again_lose_no_link(spark, monkeypatch, bucket, group):
    """Groups far larger than a bucket: the fingerprints of one centre agree in many bands."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "GROUP", group)
    fps = planted(random.Random(11), 3, 300, 4)
    classes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.linked(classes).collect()]
    assert all((a ^ b).bit_count() <= simhash.BITS for a, b in links)
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in links:
        roots[max(find(a), find(b))] = min(find(a), find(b))
    found, wanted = {}, {}
    for f, c in zip(fps, plain_components(fps, fps)):
        found.setdefault(find(f), set()).add(f)
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_table_bounds_the_distance():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 64, 500, np.uint64)
    table = simhash.distance_table(fps).astype(int)
    largest = np.abs(table[:, None, :] - table[None, :, :]).max(axis=2)
    assert (largest <= np.bitwise_count(fps[:, None] ^ fps[None, :])).all()
