from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shelflife.operators import detect

A = "abcdefghij" * 6
MATCH = {
    "OpenAI/Anthropic API Keys": [
        "sk-" + "1234567890" + "abcdefghij",
        "sk-proj-" + "a" * 50,
        "sk-ant-api03-" + "a" * 20,
    ],
    "GitHub Tokens": ["ghp_" + "a" * 36, "gho_" + "a" * 36, "github_pat_" + "a" * 22],
    "AWS Keys": ["AKIA" + "IOSF" * 4],
    "Slack Tokens": ["xoxb-" + "1" * 12],
    "PostHog Keys": ["phc_" + "a" * 30, "phx_" + "a" * 30],
}
NO_MATCH = {
    "OpenAI/Anthropic API Keys": ["sk-short", "task-" + "a" * 30],
    "GitHub Tokens": ["ghp_short"],
    "AWS Keys": ["AKIA123", "AKIA" + "a" * 16],
    "Slack Tokens": ["xoxb-1"],
    "PostHog Keys": ["phc_short"],
}
# The same tokens stated with the word boundary in front, as the SQL side states them.
PLAIN = {
    "OpenAI/Anthropic API Keys": "(sk-[A-Za-z0-9_-]{20,})",
    "GitHub Tokens": "(gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "AWS Keys": "(AKIA[0-9A-Z]{16})",
    "Slack Tokens": "(xox[abeprs]-[A-Za-z0-9-]{10,})",
    "PostHog Keys": "(ph[cx]_[A-Za-z0-9]{30,})",
}


def content(spark, texts):
    rows = [("r", str(i), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "dir_name string, item string, text string")


@pytest.mark.parametrize("wanted, samples", [(True, MATCH), (False, NO_MATCH)])
def test_samples(spark, wanted, samples):
    cases = [(name, text) for name, texts in samples.items() for text in texts]
    flags = detect.match_flags(content(spark, [t for _, t in cases])).collect()
    found = {(r["item"], r["category"]): r["matched"] for r in flags}
    assert [found[str(i), name] for i, (name, _) in enumerate(cases)] == [wanted] * len(cases)


def test_every_match_in_order(spark):
    one, two, three = ("sk-" + c * 24 for c in "abc")
    rows = detect.find_secrets(content(spark, [f"{one} {two}\n{three}", None, "", "nothing here"])).collect()
    assert [(r["item"], r["position"], r["secret"]) for r in rows] == [
        ("0", 0, one),
        ("0", 1, two),
        ("0", 2, three),
    ]


def test_whole_text_is_scanned(spark):
    token = "AKIA" + "Z" * 16
    text = "x" * 3_000_000 + " " + token
    assert detect.find_secrets(content(spark, [text])).first()["secret"] == token


def test_same_tokens_as_the_plain_statement(spark):
    rng = random.Random(3)
    parts = [t for ts in MATCH.values() for t in ts] + [t for ts in NO_MATCH.values() for t in ts]
    glue = ["", " ", "\n", "-", "_", "a", "é", ".", "sk-", "gh", "AKIA", "=", '"', "😀", "phc_", "xox"]
    texts = ["".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randrange(1, 8))) for _ in range(3000)]
    texts = [rng.choice(glue) + t for t in texts]
    expected = {
        (str(i), name, n, secret)
        for i, text in enumerate(texts)
        for name, pattern in PLAIN.items()
        for n, secret in enumerate(re.findall("(?:^|[^A-Za-z0-9_])" + pattern, text))
    }
    found = detect.find_secrets(content(spark, texts)).collect()
    assert {(r["item"], r["category"], r["position"], r["secret"]) for r in found} == expected


def test_literals_change_nothing(spark):
    rng = random.Random(4)
    parts = [t for ts in MATCH.values() for t in ts] + ["task-1", "light_", "phc", "word "]
    texts = [" ".join(rng.choices(parts, k=5)) for _ in range(500)]
    bare = [detect.Detector(d.category, d.pattern) for d in detect.BUILTIN_DETECTORS]
    df = content(spark, texts)
    assert sorted(detect.find_secrets(df).collect()) == sorted(detect.find_secrets(df, bare).collect())


def test_scanners_together(spark):
    number = "(?:id|no)=([0-9]+)"
    rules = [detect.Detector("Numbers", number, group=1)]
    seen = detect.BatchDetector("Numbers", lambda texts: texts.map(re.compile(number).findall), ("id=",))
    token = "AKIA" + "Q" * 16
    df = content(spark, [f"id=1 no=2 id=1 {token}", "no=3", None])
    rows = detect.scan_with(df, [*rules, seen]).collect()
    assert sorted((r["item"], r["category"], r["secret"], r["position"]) for r in rows) == [
        ("0", "AWS Keys", token, 0),
        ("0", "Numbers", "1", 0),
        ("0", "Numbers", "2", 1),
        ("1", "Numbers", "3", 0),
    ]
    only = detect.from_patterns({"Numbers": "no=[0-9]"})
    assert [r["secret"] for r in detect.find_secrets(df, only).collect()] == ["no=2", "no=3"]


def test_summary_and_advice(spark):
    token = "AKIA" + "Q" * 16
    df = content(spark, [f"{token} {token}", token, "clean"]).union(
        spark.createDataFrame([("quiet", "9", "clean")], "dir_name string, item string, text string")
    )
    findings = detect.find_secrets(df)
    assert [tuple(r) for r in detect.summarize(findings).collect()] == [("r", "AWS Keys", 3, 2)]
    advice = detect.recommend(df.select("dir_name").distinct(), findings).collect()
    assert sorted(tuple(r) for r in advice) == [("quiet", 0, False), ("r", 3, True)]
    items = detect.items_concerned(df.select("dir_name", "item"), findings).collect()
    assert sorted(r["item"] for r in items) == ["0", "1"]


def test_scan_does_not_shuffle(spark):
    plan = detect.find_secrets(content(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_wide_catalogue(spark):
    rules = [detect.Detector(f"K{i}", f"k{i}=([0-9]+)", (f"k{i}=",), group=1) for i in range(300)]
    rows = detect.find_secrets(content(spark, [" ".join(f"k{i}={i}" for i in range(0, 300, 7)), "k1= k2="]), rules).collect()
    assert sorted((r["category"], r["secret"]) for r in rows) == sorted((f"K{i}", str(i)) for i in range(0, 300, 7))


def test_entropy_is_shannons(spark):
    import math

    words = ["", "a", "aaaa", "abab", "0123456789abcdef" * 2, "é𝄞é𝄞", "correct horse battery"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", detect.entropy(F.col("w")).alias("bits")).collect():
        shares = [r["w"].count(c) / len(r["w"]) for c in set(r["w"])]
        assert abs(r["bits"] + sum(s * math.log2(s) for s in shares)) < 1e-12


def test_random_tokens_are_told_from_words(spark):
    texts = [
        "key " + "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "pad " + "0" * 40, "nested xx" + "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b",
        "b64 zK8qT1vYb3Wn5RxLp7Dc9Fh2Jm4Gs6Ae", "word " + "antidisestablishmentarianism",
    ]
    rows = detect.find_secrets(content(spark, texts), detect.ENTROPY_DETECTORS).collect()
    assert sorted((r["item"], r["category"]) for r in rows) == [("0", "High-entropy hex"), ("3", "High-entropy base64")]
    flags = detect.match_flags(content(spark, texts), detect.ENTROPY_DETECTORS).where("matched").collect()
    assert sorted((r["item"], r["category"]) for r in flags) == [("0", "High-entropy hex"), ("3", "High-entropy base64")]


def test_a_gate_changes_nothing(spark):
    find = lambda texts: texts.map(re.compile("id=[0-9]+").findall)
    df = content(spark, ["id=1 id=22", "none", None, "id=", "x id=3"])
    plain, gated = (detect.find_secrets(df, [detect.BatchDetector("N", find, gate=g)]).collect() for g in (None, "id=[0-9]"))
    assert sorted(plain) == sorted(gated) and len(plain) == 3


def test_sketches_of_scans_roll_up(spark):
    """Twenty thousand items over ten scans, each item in several: within five standard errors, and exact while few."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 'a', 'b') AS dir_name", "'K' AS category", "cast(id % 20000 AS string) AS item", "id % 10 AS scan")
    few = rows.where("cast(item AS int) < 1000")
    for findings, error in ((rows, 5 / 2 ** (detect.SKETCH_BITS / 2)), (few, 0)):
        found = {r["dir_name"]: r for r in detect.roll_up(detect.summary_sketches(findings, ["scan"])).collect()}
        for r in detect.summarize(findings).collect():
            assert found[r["dir_name"]]["matches"] == r["matches"]
            assert abs(found[r["dir_name"]]["items"] - r["items"]) <= error * r["items"]


def test_many_detectors_find_what_each_finds(spark, monkeypatch):
    """Literals inside each other, overlapping, and of several characters that mean something in a pattern."""
    rng = random.Random(12)
    parts = ["ab", "abc", "bc", "b.", "k1=", "k12=", "1=", "(x)", "é-", "-=", "=-=", "aa", "aaa"]
    rules = [detect.Detector(f"D{i}", re.escape(lit) + "([0-9a-z]{1,3})", (lit,), group=i % 2) for i, lit in enumerate(parts)]
    rules += [detect.Detector("Two", "(?:ab|é-)[0-9]", ("ab", "é-")), detect.Detector("None", "[0-9]{4}")]
    texts = ["".join(rng.choice([*parts, "0", "7z", " ", "xyz"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    df = content(spark, [*texts, None, ""])
    plain = sorted(detect.find_secrets(df, rules).collect())
    monkeypatch.setattr(detect, "WIDE", 3)
    found = detect.find_secrets(df, rules)
    assert sorted(found.collect()) == plain and len(plain) > 1000
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
