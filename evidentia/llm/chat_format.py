"""Operator 7: conversations as training texts with a loss mask, by Spark expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role merged
into a block; each block and each turn in it is marked by a control string.
Control strings inside a text or role (the template's own and those of common
chat formats) get a backslash after their first character, one more than they
have already, so that every text can be read back exactly.

Scale.  One shuffle, by conversation.  A conversation becomes one text, as a
training example must, and so is bounded by what a string can hold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let, running_sums

BLOCK, BODY, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Control strings that no text may bring in: the template's and those of other chat formats.
RESERVED = (BLOCK, BODY, NEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_REST = "|".join(re.escape(x[1:]).replace("/", "\\/") for x in RESERVED)
ESCAPED, UNESCAPED = rf"([<\[])(\\*)({_REST})", rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """One row for each conversation: its id, ``formatted`` and ``loss_spans``.

    Turns stand in order of ``turn`` (nulls first), then of role and text, so
    that tied and repeated rows have one order; all are kept.  A null role or
    text is an empty one.  ``loss_spans`` (``start``, ``size`` in code points)
    cover the texts of the role ``learned`` and no control string.  Each row
    without a conversation id is a conversation of its own.  A conversation may
    be as long as a string can be.  Other columns are ignored, whatever their
    names.
    """
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    rows = turns.select(F.col(id_col).alias("conv"), alone.alias("alone"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("turn"))
    sorted_turns = rows.groupBy("conv", "alone").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    def marked(ts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            opens = (i == 0) | (x["role"] != F.get(ts, i - 1)["role"])
            head = F.when(opens, F.concat(F.when(i > 0, END).otherwise(""), F.lit(BLOCK), escape(x["role"]), F.lit(BODY))).otherwise(NEXT)
            return F.struct(head.alias("head"), escape(x["text"]).alias("body"), (x["role"] == learned).alias("learned"))

        return F.transform(ts, one)

    pieces = sorted_turns.select("conv", let(F.col("turns"), marked).alias("pieces"))

    def laid(ps: Column) -> Column:
        ends = running_sums(F.transform(ps, lambda p: (F.length(p["head"]) + F.length(p["body"])).cast("long")))
        spans = F.zip_with(ps, ends, lambda p, e: F.struct((e - F.length(p["body"])).alias("start"), F.length(p["body"]).alias("size"), p["learned"].alias("learned")))
        kept = F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size")))
        return F.struct(F.concat(F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END)).alias("formatted"), kept.alias("loss_spans"))

    return pieces.select(F.col("conv").alias(id_col), let(F.col("pieces"), laid).alias("laid")).select(id_col, "laid.formatted", "laid.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns (``role``, ``text``) that a formatted conversation holds."""
    literal = lambda s: re.escape(s)

    def block(b: Column) -> Column:
        role = unescape(F.substring_index(b, BODY, 1))
        body = F.regexp_replace(F.split(b, literal(BODY), 2)[1], literal(END) + "$", "")
        return F.transform(F.split(body, literal(NEXT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, literal(BLOCK), -1), lambda b: b != ""), block))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int"))))


def chat_digests(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, as counts and digests."""
    done = format_conversations(turns)
    read = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
