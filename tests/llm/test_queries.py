"""The registered queries against their SQL, or against what any result must hold; the pipeline by its stages."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from compare import connect, differences
from shelflife.llm import langid, mixing, neardup, pii, queries
from shelflife.llm.common import read_table, written

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = contract.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 1 + len(queries.QUERIES)))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL and n[:3] not in ("op1", "op8")])
def test_one_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in read_table(spark, SMALL, "documents").select("doc_id").collect())


def stages(spark, docs, sf_dir=SMALL):
    """The rows each stage was given and gave."""
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), name)
        yield name, docs, out
        docs = out


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def check(spark, docs):
    for name, given, got in stages(spark, docs):
        if name != "packing":
            assert got.columns == given.columns
            extra = [c for c in given.columns if c not in COLUMNS]
            assert rows_of(got, extra).keys() <= rows_of(given, extra).keys()
        before, after = (rows_of(x, COLUMNS) for x in (given, got)) if name != "packing" else (rows_of(given, COLUMNS), None)
        if name == "language":
            filters = langid.trained(given)
            keep = {r["doc_id"]: r for r in langid.identify(given, filters).collect()}
            assert set(k[0] for k in after) == {i for i, r in keep.items() if r["lang_pred"] != "und" and r["score"] > 0}
            assert all(k[2] is not None for k in after)
        elif name == "near-duplicates":
            kept = {r["doc_id"] for r in neardup.near_duplicates(given).where("kept").collect()}
            assert {k[0] for k in after} == kept and after - before == Counter()
            assert neardup.near_duplicates(got).where("not kept").count() == 0
        elif name == "pii":
            assert sorted((k[0] is None, k[0]) for k in after.elements()) == sorted((k[0] is None, k[0]) for k in before.elements())
            assert pii.detect(got).where("size(pii) > 0").count() == 0
            clean = {r["doc_id"] for r in pii.detect(given).where("size(pii) = 0").collect()}
            assert {k[:4] for k in after if k[0] in clean} == {k[:4] for k in before if k[0] in clean}
            assert all(k[4] == (len(k[1]) if k[1] is not None else None) for k in after)
        elif name == "mixing":
            # The words written are those the mix takes, per document and so in all.
            words = lambda rows: sum(n * len((k[1] or "").encode().split()) for k, n in rows.items())
            taken, per_doc = Counter(), Counter()
            for r in mixing.mix(given).collect():
                taken[r["doc_id"]] += r["taken"]
            for k, n in after.items():
                per_doc[k[0]] += n * len((k[1] or "").encode().split())
            assert per_doc == +taken
            assert words(after) <= 3 * words(before)
        else:
            assert rows_of(got, ["doc_id"]) == rows_of(given, ["doc_id"])


def test_pipeline_on_driver_rows(spark):
    check(spark, read_table(spark, SMALL, "documents"))


def test_pipeline_rejects_unknown_languages(spark):
    rng = random.Random(10)
    alphabets = [[chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(0x4E00, 0x9FFF)], list("abcdefghijklmnopqrstuvwxyz")]
    texts = [" ".join("".join(rng.choices(a, k=6)) for _ in range(80)) for a in alphabets for _ in range(50)]
    docs = read_table(spark, SF, "documents")
    planted = spark.createDataFrame([(-1 - k, text, None, "planted", len(text)) for k, text in enumerate(texts)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(planted), SF).select("doc_id").collect()}
    letters = {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert kept == letters


def test_pipeline_on_odd_rows(spark, odd):
    check(spark, odd)


INNER = """passes words_to words_from taken row size source_size target source_no shards blocks shard shard_words quota at
key __key __kept __times __row __spans __lang __score pii spans found text_key n_tokens bound batch padding bucket bucket_len number first_row
root hashes n kept component_id lang_pred score grams""".split()


def test_pipeline_with_callers_columns_of_any_name(spark):
    """Every name the stages use inside, as a column of the caller's; and rows that are repeated."""
    docs = read_table(spark, SMALL, "documents").where("doc_id < 60")
    docs = docs.union(docs.where("doc_id % 2 = 0")).select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in INNER))
    check(spark, docs)


def test_mixing_stage_writes_the_words_it_takes_also_of_repeated_rows(spark):
    docs = read_table(spark, SMALL, "documents").where("doc_id < 100")
    docs = docs.union(docs)
    taken = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    written_ = corpus_pipeline.mix(spark, docs, SMALL).agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert written_ == taken


def test_pipeline_on_no_rows(spark, no_docs):
    for _, _, got in stages(spark, no_docs):
        assert got.collect() == []


def test_run_equals_its_stages(spark):
    for _, _, last in stages(spark, read_table(spark, SMALL, "documents")):
        pass
    found = corpus_pipeline.run(spark, SMALL)
    assert rows_of(found, found.columns) == rows_of(last, found.columns)
