"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.llm import ann, chat, html_crf, langid, lattice, merkle, mixing, neardup, packing, pii, repair, simhash, whiten
from shelflife.llm.common import held_out, read_table
from shelflife.llm.oracle import ORACLE_SQL as ORACLE_SQL

CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    filters = langid.trained(docs)
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", held_out("doc_id", langid.HELD_OUT_MODULUS).alias("held_out"), "lang_pred", "score")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(read_table(spark, sf_dir, "documents"))


def op5_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], columns)
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    read = chat.read_chats(chat.format_chats(turns))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_ann_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op9_lattice_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    base = [k.name for k in pii.KINDS if k.base]
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    listed = lambda spans: F.array_join(F.transform(spans, line), ",")
    of_kind = lambda name: F.filter("pii", lambda s: s["kind"] == F.lit(name))
    counts = [F.size(of_kind(name)).cast("long").alias(f"n_{name}") for name in base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed("pii").alias("spans"),
    )


def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_source_mixing": op3_source_mixing,
    "op4_merkle_fingerprints": op4_merkle_fingerprints,
    "op5_length_packing": op5_length_packing,
    "op6_minhash_neardup": op6_minhash_neardup,
    "op7_chat_format": op7_chat_format,
    "op8_ann_cross_polytope": op8_ann_cross_polytope,
    "op9_lattice_scoring": op9_lattice_scoring,
    "op10_pii": op10_pii,
    "op11_simhash_neardup": op11_simhash_neardup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}
