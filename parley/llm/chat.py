"""Relational chat formatting with Spark expressions only.

One conversation is one string: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline
per block. Turns are collected as structs and sorted; adjacent turns of one role merge into
one block whose texts are kept apart by ``<|im_sep|>``, so single turns can be read back. A
turn opens a block if its predecessor in the sorted array has another role, which needs one
look back per element; the pieces are then joined by an array aggregation.

Control strings inside roles and texts are escaped: a backslash becomes two, ``<|`` becomes
``<\\|``; unescaping drops the backslash before any character. The loss mask is the list of
pieces whose concatenation is the string, each with a flag: true for assistant texts.

Nulls: a null role or text is empty, a null turn sorts first, a null conv_id is a
conversation of its own. Ties in turn go by role, then text; repeated rows are turns of
their own. Other columns are not read. A conversation is one value in the output, so its
turns meet in one task by nature; the longest is bounded by what one string may hold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, pieces array<struct<text, loss>>) per conversation."""
    sorted_turns = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))).alias("turns"))
    role = lambda t: F.coalesce(t["role"], F.lit(""))

    def pieces(t: Column, i: Column) -> Column:
        opens = F.concat(F.lit(START), escape(role(t)), F.lit(SEP))
        marker = F.when(i == 0, opens).when(
            role(F.get("turns", i - 1)) == role(t), F.lit(SEP)).otherwise(F.concat(F.lit(END), opens))
        return F.array(F.struct(marker.alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(F.coalesce(t["text"], F.lit(""))).alias("text"), (role(t) == LOSS_ROLE).alias("loss")))

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    out = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), last).alias("pieces"))
    return out.select("conv_id", F.array_join(F.col("pieces.text"), "").alias("formatted"), "pieces")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text) parsed from the strings and
    masks that ``format_conversations`` made."""
    blocks = formatted.select("*", F.filter(
        F.split("formatted", r"\Q" + END + r"\E"), lambda b: b != "").alias("blocks"))
    parts = blocks.select("*", F.transform(
        "blocks", lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), r"\Q" + SEP + r"\E")).alias("parts"))
    turns = F.flatten(F.transform("parts", lambda p: F.transform(
        F.slice(p, 2, F.size(p) - 1),
        lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform(F.filter("pieces", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    return parts.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(turns: DataFrame) -> DataFrame:
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
