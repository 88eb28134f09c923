"""Perspective rotation of conversations, in built-in functions only.

For every participant the whole dialogue is rendered with that speaker as the assistant and all
others as named users; only the speaker's own turns are trained on. Long conversations come in
parts of a bounded range of turns, so none is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that set the scene: rendered as they are, never trained on, never a perspective.
SCENE = ("system",)
#: Turn numbers covered by one rendered part.
PART_TURNS = 256
#: Role of turns that name none.
UNKNOWN = "unknown"


def perspectives(df: DataFrame, scene: tuple[str, ...] = SCENE, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask, spans, trained_chars``.

    A turn is ``<|im_start|>assistant``, ``<|im_start|>user name=...`` or ``<|im_start|>system``, a
    line break, the text, ``<|im_end|>`` and a line break. ``mask`` has a sign per turn, 1 where the
    turn is trained on; ``spans`` are the code points of those texts with their end mark, as
    ``start:end`` pairs joined by blanks. ``part`` is the turn number divided by ``part_turns``
    (-1 for turns without a number).

    Turns go by number, then role, then text; repeated rows are kept. A null or blank role is
    ``unknown``, a null text is empty, turns without a conversation are one conversation of their
    own. A conversation without participants (only scene roles) has one row, speaker null and
    nothing trained. Other columns of ``df`` are ignored.
    """
    role = F.when(F.trim("role") == "", None).otherwise(F.trim("role"))
    turns = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(role, F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
    )
    acts = ~F.col("role").isin(*scene) if scene else F.lit(True)
    people = turns.groupBy("conv_id", "role").agg(F.lit(1).alias("one"))
    speakers = people.where(acts).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker"))
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = (
        F.when(own, F.lit("assistant"))
        .when(acts, F.concat(F.lit("user name="), F.col("role")))
        .otherwise(F.col("role"))
    )
    head = F.concat(F.lit("<|im_start|>"), head, F.lit("\n"))
    said = F.concat(F.col("text"), F.lit("<|im_end|>"))
    item = F.struct("turn", "role", F.col("text").alias("said"), own.alias("own"), head.alias("head"), said.alias("body"))
    lines = seen.select("conv_id", "speaker", "part", item.alias("item")).groupBy("conv_id", "speaker", "part")
    grouped = lines.agg(F.sort_array(F.collect_list("item")).alias("items"))
    start = F.aggregate(
        "items",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + 1).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.concat_ws(
                            ":",
                            (acc["at"] + F.char_length(x["head"])).cast("string"),
                            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"])).cast("string"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: F.array_join(acc["spans"], " "),
    )
    return grouped.select(
        "conv_id",
        "speaker",
        "part",
        F.size("items").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.transform("items", lambda x: F.when(x["own"], F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        start.alias("spans"),
        F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.when(x["own"], F.char_length(x["body"])).otherwise(0)).alias("trained_chars"),
    )
