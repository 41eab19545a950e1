"""Chat rendering from every participant's point of view, in DataFrame functions only.

For each participant of a conversation the whole dialogue is rendered with that speaker as
``assistant`` and all others as named users; system turns stay system turns.  The mask
lists the character spans to learn from: the speaker's own texts with their end mark.

A conversation is cut into segments of ``max_turns`` turn numbers, so no row grows without
bound; spans count from the start of their segment.  Turns go by (turn, role, text), so
equal turn numbers have a defined order; rows that repeat stay.  A null turn comes first
(segment 0), a null role is the speaker ``unknown``, a null text is empty.  Null
``conv_id`` rows form one conversation.  Who only has system turns has no participant and
gives no row.  Any further column is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|begin|>", "<|end|>"
SYSTEM = "system"


def _head(me: Column, role: Column) -> Column:
    mine = F.when(role == me, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), mine, F.lit("\n"))


def rotate(turns: DataFrame, *, key: str = "conv_id", max_turns: int = 512) -> DataFrame:
    """``(key, participant, segment, n_turns, n_target_turns, rendered, mask)``; mask is an array of (begin, end)."""
    rows = turns.select(
        F.col(key).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / max_turns), F.lit(0)).cast("long").alias("segment"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"),
    )
    segments = rows.groupBy("conv", "segment").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    # The names of a conversation meet its segments by key; both sides are aggregated first.
    names = rows.where(F.col("m.role") != SYSTEM).groupBy("conv").agg(F.collect_set("m.role").alias("names"))
    met = segments.join(names, segments.conv.eqNullSafe(names.conv)).select(segments.conv, "segment", "ms", F.explode("names").alias("me"))
    me = F.col("me")
    parts = F.transform("ms", lambda m: F.struct(_head(me, m.role).alias("head"), F.concat(m.text, F.lit(END)).alias("body"), (m.role == me).alias("mine")))
    sized = met.withColumn("parts", parts)
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc.at + F.length(p.head) + F.length(p.body) + 1).cast("long").alias("at"),
            F.when(p.mine, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(p.head)).cast("long").alias("begin"), (acc.at + F.length(p.head) + F.length(p.body)).cast("long").alias("end"))))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return sized.select(
        F.col("conv").alias(key),
        me.alias("participant"),
        "segment",
        F.size("parts").cast("long").alias("n_turns"),
        F.size(F.filter("parts", lambda p: p.mine)).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("rendered"),
        spans.alias("mask"),
    )
