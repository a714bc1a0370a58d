"""Multi-party perspective rotation for chat training.

For every participant of a conversation the dialogue is rendered with that
participant as the assistant and all others as named users; the mask lists the
spans (code points, end exclusive) of what the assistant says, closing mark
included.  Turns of ``system`` speakers stay system turns in each perspective.

A rendering comes in parts of ``part_turns`` turn numbers, so that a
conversation of any length is dealt over many tasks; a part's mask counts from
the part's start.  Texts are shuffled once; participants are joined to whole
parts.

Defined results.  Turns are ordered by turn, speaker, text; a null turn number
counts as turn 0 and sorts first.  Rows that repeat are rendered as often as
they occur.  A null text is empty, a null speaker is the user ``unknown``,
and no participant.  A null conversation id is a conversation.  Marks within
texts are broken up, so that a text cannot forge a turn.  A conversation
without participants has no row.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def _head(speaker: Column, me: Column, system: str) -> Column:
    name = F.regexp_replace(F.coalesce(speaker, F.lit("unknown")), r"[\s<>|]", "_")
    return F.concat(F.lit(OPEN), F.when(speaker.eqNullSafe(F.lit(system)), F.lit("system")).when(speaker.eqNullSafe(me), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system", part_turns: int = 256) -> DataFrame:
    """(conv_id, part, perspective, n_turns, rendered, mask, n_masked) of every part and participant."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), F.col(speaker_col).alias("speaker"), _clean(F.col(text_col)).alias("text"))
    people = rows.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / part_turns).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("said"))
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
    me = F.col("perspective")
    pieces = F.transform(
        "said",
        lambda t: F.struct(_head(t["speaker"], me, system).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["speaker"] == me).alias("mine")),
    )
    each = each.withColumn("_p", pieces)
    spans = F.aggregate(
        F.transform("_p", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), F.coalesce(p["mine"], F.lit(False)).alias("m"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            (a["at"] + p["h"] + p["b"] + 1).alias("at"),
            F.when(p["m"], F.array_append(a["out"], F.concat_ws(":", (a["at"] + p["h"]).cast("string"), (a["at"] + p["h"] + p["b"]).cast("string")))).otherwise(a["out"]).alias("out"),
            (a["n"] + F.when(p["m"], p["b"]).otherwise(0)).alias("n"),
        ),
    )
    return each.withColumn("_s", spans).select(
        "conv_id",
        "part",
        "perspective",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join("_s.out", ",").alias("mask"),
        F.col("_s.n").cast("long").alias("n_masked"),
    )
