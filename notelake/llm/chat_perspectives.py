"""Multi-party perspective rotation of conversations, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
the others as named users; a system turn stays a system turn. What the rotated speaker says carries
the training mask. The result has one row per perspective and turn, in order, with the code point
range that the turn's text takes in the rendered dialogue, so that neither a long conversation nor its
masks are ever gathered in one task:

    <|assistant|>\\n{text}\\n        <|user:{role}|>\\n{text}\\n        <|system|>\\n{text}\\n

``rendered`` joins the segments for conversations of bounded size.

Places come from prefix sums in two levels: within blocks of turns, and over the sums of the blocks.

Defined results: a null role reads "unknown", a null text is empty; rows of one turn are ordered by role,
then text, repeated rows stay and are all rendered; rows without turn come first; rows without conv_id
form one conversation; a conversation of system turns only has no participants and no rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settled

SYSTEM = "system"
# Turns per block of the prefix sums.
BLOCK = 256


def rotated(conversations: DataFrame, system: str = SYSTEM, block: int = BLOCK) -> DataFrame:
    """conv_id, speaker, position, turn, role, segment, mask, text_start, text_end: per perspective and turn."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A row's place: how many rows of its conversation lie in earlier blocks, and its number in its block.
    cut = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    turns = turns.withColumn("block", cut.cast("long"))
    speakers = turns.where(F.col("role") != system).select("conv_id", F.col("role").alias("speaker")).distinct()
    speakers = settled(speakers, "op7-speakers")
    same = turns["conv_id"].eqNullSafe(speakers["conv_id"])
    views = turns.join(speakers, same).select(turns["*"], "speaker")
    is_own = F.col("role") == F.col("speaker")
    head = F.when(is_own, F.lit("<|assistant|>\n")).when(F.col("role") == system, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user:"), F.col("role"), F.lit("|>\n")))
    views = views.select("conv_id", "speaker", "turn", "role", "block", F.concat(head, "text", F.lit("\n")).alias("segment"),
                         is_own.alias("mask"), F.length(head).alias("head"), F.length("text").alias("body"))
    key = ["conv_id", "speaker"]
    inside = Window.partitionBy(*key, "block").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = (F.col("head") + F.col("body") + 1).cast("long")
    views = views.withColumn("size", size).withColumn("till", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    sums = views.groupBy(*key, "block").agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("block_rows"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"s_{c}") for c in (*key, "block")],
                       F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("block_rows").over(before), F.lit(0)).alias("rows_before"))
    matched = views["conv_id"].eqNullSafe(sums["s_conv_id"]) & (views["speaker"] == sums["s_speaker"]) & (views["block"] == sums["s_block"])
    start = (F.col("size_before") + F.col("till") - F.col("size") + F.col("head")).cast("long")
    return views.join(sums, matched).select(
        "conv_id", "speaker", (F.col("rows_before") + F.col("nth") - 1).cast("long").alias("position"), "turn", "role", "segment", "mask",
        start.alias("text_start"), (start + F.col("body")).alias("text_end"))


def rendered(views: DataFrame) -> DataFrame:
    """One row per perspective: conv_id, speaker, dialogue, spans (start, end of what is trained on). For conversations that fit one row."""
    own = F.filter("parts", lambda p: p["mask"])
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "mask", "text_start", "text_end"))).alias("parts")
    return views.groupBy("conv_id", "speaker").agg(parts).select(
        "conv_id", "speaker", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("dialogue"),
        F.transform(own, lambda p: F.struct(p["text_start"].alias("start"), p["text_end"].alias("end"))).alias("spans"))
