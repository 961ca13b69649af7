"""Chat formatting by multi-party perspective rotation.

Every conversation is rendered once per participant: that speaker's turns are
the assistant's, all others are users carrying their names, and a mask marks
what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn markers of the rendered text (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Marks the character that is put into a marker-like piece of content to disarm it.
GUARD = "\u200b"

TURNS_PER_PART = 256


def disarm(text: Column) -> Column:
    """Content with every `<|` broken up, so that it can't open or close a turn; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit(f"<{GUARD}|"))


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, n_turns, rendered, mask.

    `mask` lists (begin, end) character spans, the assistant's contents with
    their closing marker.  A part covers the turns from part * turns_per_part
    on, so a conversation of any length is rendered in pieces of bounded size
    and nothing is cut off; usual conversations have part 0 alone.  Every part
    is rendered for every participant of the whole conversation.

    Turns go by number; a null number counts as 0, ties go by role, then text,
    and repeated rows are rendered as often as they come.  A null role is a
    participant named "unknown", a null text is empty, a null conversation id
    is a conversation.  Other columns are ignored.  An empty table gives an
    empty result.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        disarm(F.col(text_col)).alias("text"),
    )
    part = F.floor(F.col("turn") / F.lit(turns_per_part)).cast("long")
    parts = t.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = t.select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    mine = lambda x: x["role"] == F.col("speaker")
    head = lambda x: F.when(mine(x), F.lit(f"{OPEN}assistant\n")).otherwise(
        F.concat(F.lit(f"{OPEN}user name="), F.replace(disarm(x["role"]), F.lit("\n"), F.lit(" ")), F.lit("\n"))
    )
    body = lambda x: F.concat(x["text"], F.lit(CLOSE))
    pieces = rows.withColumn("pieces", F.transform("turns", lambda x: F.struct(mine(x).alias("own"), head(x).alias("head"), body(x).alias("body"))))
    rendered = F.concat_ws("\n", F.transform("pieces", lambda p: F.concat(p["head"], p["body"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = (begin + F.length(p["body"])).cast("long")
        span = F.struct(begin.cast("long").alias("begin"), end.alias("end"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), rendered.alias("rendered"),
        F.aggregate("pieces", start, step)["spans"].alias("mask"),
    )
