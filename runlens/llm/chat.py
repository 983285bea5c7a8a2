"""Chat formatting from event logs: fold events into messages, render them with a reversible template.

An event log has one row per event:

- ``message`` opens message ``msg`` with a role and a first text,
- ``delta`` appends its text to the message,
- ``edit`` replaces the message's text,
- ``regenerate`` drops the message's text and every later message that was there before it; deltas follow. Its role is
  ``assistant`` unless it names one.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per message. Inside roles and texts a backslash becomes ``\\b``
and ``<|`` becomes ``<\\p``, so no text can hold a control string and the escape can be undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log (conv_id, seq, msg, kind, role, text).

    Events are folded in the order of ``seq``; events of one ``seq`` in the order of KINDS, then of text. NULL texts are empty.
    The role is the latest non-null one. A conversation's events are shuffled once, by conv_id. Unknown kinds and
    NULL kinds count as ``message``. NULL conversation ids form one conversation.
    """
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message")
    rank = F.expr("case kind when 'message' then 0 when 'regenerate' then 1 when 'edit' then 2 else 3 end")
    role = F.coalesce("role", F.when(F.col("kind") == "regenerate", TRAINED_ROLE))
    e = events.select("conv_id", "seq", "msg", kind.alias("kind"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("_order", F.struct("seq", rank.alias("rank"), "text"))
    upto = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    void = F.max(F.when(F.col("kind") == "regenerate", F.col("_order"))).over(upto)
    e = e.withColumn("_void", void).where(F.col("_void").isNull() | (F.col("_order") >= F.col("_void")))
    fresh = F.max(F.when(F.col("kind") != "delta", F.col("_order"))).over(Window.partitionBy("conv_id", "msg"))
    e = e.withColumn("_fresh", fresh).withColumn("_live", F.col("_fresh").isNull() | (F.col("_order") >= F.col("_fresh")))
    parts = F.sort_array(F.collect_list(F.when(F.col("_live"), F.struct("_order", "text"))))
    return e.groupBy("conv_id", "msg").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_order"))).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (offset and length in code points of assistant texts).

    Messages are ordered by ``msg``. NULL roles and texts are empty. A conversation must fit one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    m = messages.select("conv_id", F.struct("msg", head.alias("head"), escape(text).alias("body"), (role == TRAINED_ROLE).alias("loss")).alias("m"))
    turns = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    size = F.transform("turns", lambda t: F.struct((F.length(t["head"])).alias("head"), F.length(t["body"]).alias("body"), t["loss"].alias("loss")))
    spans = F.aggregate(
        size,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + len(END) + 1).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Read the turns back: array of (role, text)."""
    pieces = F.split(F.substr(formatted, F.lit(len(START) + 1)), r"<\|im_start\|>", -1)

    def turn(p: Column) -> Column:
        return F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END) - 1)).alias("text"),
        )

    return F.when(F.length(formatted) > 0, F.transform(pieces, turn)).otherwise(F.array().cast("array<struct<role:string,text:string>>"))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
