"""Operator 9: chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and neighbours of one
role merged with array aggregation; a message is written as

    <|im_start|>role NEWLINE text <|turn|> text ... <|im_end|> NEWLINE

with ``<|turn|>`` between merged turns.  Inside texts and roles every ``<`` that is followed by
backslashes and ``|`` gets one more backslash, so no text can hold a control string, and
taking one backslash away restores it; a role's backslashes and line feeds are written
``\\\\`` and ``\\n``.  The loss mask is a list of spans (first code point, length) of the
formatted text: each assistant turn's text, without what stands around it; its places
are running sums over the sorted turns, so work is linear in the turns.

``read_back`` parses formatted texts alone, again with expressions only.

Null text or role: empty.  Null turn numbers come first; equal turn numbers and repeated rows are
ordered by role, then text, and all kept.  Null ``conv_id``: a conversation of its
own kind, as in grouping.  An empty table gives no rows.  Other columns are ignored.
A conversation is one training example and so one row; conversations are what is distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophekit.llm.common import let

START, END, TURN = "<|im_start|>", "<|im_end|>", "<|turn|>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``."""
    plain = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    inside = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    told = plain.select(
        "conv_id", "turn", "role", "text", escaped_role(F.col("role")).alias("said_role"), escaped(F.col("text")).alias("said"),
        F.row_number().over(inside).alias("k"), F.coalesce(F.col("role") != F.lag("role").over(inside), F.lit(True)).alias("opens"))
    # Code points of a turn: the end of the message before, its own marks, its text.
    marks = F.when(F.col("opens"), len(START) + F.char_length("said_role") + 1 + F.when(F.col("k") > 1, len(END) + 1).otherwise(0)).otherwise(len(TURN))
    size = F.char_length("said").cast("long")
    so_far = F.sum(marks + size).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = told.select("conv_id", F.struct(
        "k", "opens", F.col("said_role").alias("role"), F.col("said").alias("text"), (F.col("role") == LEARNED_ROLE).alias("learned"),
        (so_far - size).alias("start"), size.alias("length")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def merged(turns: Column) -> Column:
        """Messages: the turns from each that opens one up to the next such."""
        opens = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["opens"])
        return let(opens, lambda first: F.transform(first, lambda i, k: F.struct(
            F.get(turns, i)["role"].alias("role"),
            F.transform(F.slice(turns, i + 1, F.coalesce(F.get(first, k + 1), F.size(turns)) - i), lambda t: t["text"]).alias("texts"))))

    def written(m):
        return F.concat(F.lit(START), m["role"], F.lit("\n"), F.array_join(m["texts"], TURN), F.lit(END + "\n"))

    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    messages = sorted_turns.select("conv_id", let(F.col("turns"), merged).alias("messages"), spans.alias("loss_spans"))
    return messages.select("conv_id", F.array_join(F.transform("messages", written), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns (role, text), loss_texts``, from the formatted texts and spans alone."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    messages = F.slice(parts, F.lit(2), F.size(parts) - 1)
    bodies = F.transform(messages, lambda m: F.substring_index(m, END, 1))

    def turns_of(body):
        def of_role(role):
            texts = F.split(F.substring(body, F.char_length(role) + 2, F.char_length(body)), r"<\|turn\|>", -1)
            return let(unescaped_role(role), lambda plain: F.transform(
                texts, lambda t: F.struct(plain.alias("role"), unescaped(t).alias("text"))))
        return let(F.substring_index(body, "\n", 1), of_role)

    # Four bytes a code point, so that a span is cut at its own place without walking the text before it;
    # the mark in front keeps a span's own first U+FEFF from being taken for one.
    def cut(wide, s):
        own = F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))
        return unescaped(F.decode(F.concat(F.unhex(F.lit("0000FEFF")), own), "UTF-32"))

    loss = let(F.encode("formatted", "UTF-32"), lambda wide: F.transform("loss_spans", lambda s: cut(wide, s)))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(bodies, turns_of)).alias("turns"), loss.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what is read back."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
