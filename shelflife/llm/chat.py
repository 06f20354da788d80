"""Chat formatting by relational expressions: sorted turn structs, merged blocks, one string per conversation.

A block is a run of turns of one role::

    <|user|>\\nfirst text<|next|>second text<|end|>\\n

Texts and roles are escaped so that no ``<`` or ``>`` of theirs is left; every angle bracket in the output is
the template's own, and unescaping gives back the text code point by code point.

Defined cases: a null role is the empty role, a null text the empty text; rows without a conversation id form
one conversation; turns are ordered by (turn, role, text), a null turn first, repeated rows are kept as turns
of their own; an empty table gives an empty result. A conversation is one output value, so its turns meet in
one task, which takes time in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelflife.llm.common import chunks, collect_over, cut, let

END, NEXT = "<|end|>\n", "<|next|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for char, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def format_chats(turns: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text", loss_role=LOSS_ROLE) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are (start, chars) code point ranges of ``formatted`` that hold the escaped texts of
    ``loss_role``, in order and without the marks between them.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    # Null ids become a key of their own anyway; groupBy keeps them together.
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where blocks start (1-based): the first turn and each turn whose role differs from the one before.
    chats = chats.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(1), F.size("turns")),
            lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]),
        ),
    )
    chats = chats.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda start, k: F.struct(
                F.get("turns", start - 1)["role"].alias("role"),
                F.transform(
                    F.slice("turns", start, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - start),
                    lambda t: t["text"],
                ).alias("texts"),
            ),
        ),
    )
    formatted = F.array_join(
        F.transform(
            "blocks",
            lambda b: F.concat(_header(b["role"]), F.array_join(b["texts"], NEXT), F.lit(END)),
        ),
        "",
    )
    return chats.select("conv_id", formatted.alias("formatted"), _loss_spans(loss_role).alias("loss_spans"))


def _loss_spans(loss_role: str) -> Column:
    """Walk the turns with the offset reached so far; keep the spans of texts of the loss role."""

    def walk(state: Column, turn: Column) -> Column:
        opens = state["role"].isNull() | (state["role"] != turn["role"])
        # Before a text stand the mark to the text before it, or the end of a block and the header of its own.
        header = F.length(turn["role"]) + len("<||>\n") + F.when(state["role"].isNull(), 0).otherwise(len(END))
        start, size = state["at"] + F.when(opens, header).otherwise(len(NEXT)), F.length(turn["text"])
        span = F.struct(start.alias("start"), size.alias("chars"))
        own = F.when(turn["role"] == F.lit(loss_role), F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct((start + size).alias("at"), turn["role"].alias("role"), own.alias("out"))

    start = {"at": F.lit(0), "role": F.lit(None).cast("string")}
    return collect_over(F.col("turns"), start, walk, "struct<start:int,chars:int>")


def read_chats(chats: DataFrame) -> DataFrame:
    """Parse ``formatted`` back: ``turns`` as (role, text) structs, and ``loss_text`` from the spans."""
    blocks = F.transform(
        F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != ""),
        lambda b: F.struct(
            unescape(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
            F.split(F.regexp_replace(b, r"(?s)^<\|.*?\|>\n", ""), r"<\|next\|>").alias("texts"),
        ),
    )
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text"))
            ),
        )
    )
    loss = let(
        chunks(F.col("formatted")),
        lambda parts: F.array_join(F.transform("loss_spans", lambda s: unescape(cut(parts, s["start"], s["chars"]))), ""),
    )
    return chats.select("conv_id", "formatted", "loss_spans", turns.alias("turns"), loss.alias("loss_text"))
