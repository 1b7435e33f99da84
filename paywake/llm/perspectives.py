"""Chat formatting: each dialogue once from the side of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.functions.joins import join_on
from paywake.plans.positions import split_positions

MESSAGES = 64       # of a dialogue that one rendered example trains on or could
OVERLAP = 8         # messages before them that it shows again as context
START, END = "<|start|>", "<|end|>\n"


def _header(role: Column, name: Column) -> Column:
    """<|start|>role, and the speaker's name where the speaker is a user."""
    return F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), name)).otherwise(""), F.lit("\n"))


def _said(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def dealt(conversations: DataFrame) -> DataFrame:
    """conv_id, no, speaker, text, part, again: the messages of each dialogue, numbered and dealt into parts.

    A dialogue of any length, or one turn with any number of messages, is numbered across range partitions. A part is
    MESSAGES messages; before them it has `again` the OVERLAP messages in front of it and the dialogue's first
    system message.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "text")]
    placed = split_positions(_said(conversations), ["conv_id"], order, "no", "size")
    own = F.floor((F.col("no") - 1) / MESSAGES)
    last = F.floor((F.col("size") - 1) / MESSAGES)
    first = placed.where(F.col("speaker") == "system").groupBy("conv_id").agg(F.min("no").alias("system_no"))
    rows = join_on(placed.select("*", own.alias("own"), last.alias("last")), first, ["conv_id"], "left")
    # the first part whose messages and overlap are all behind the system message
    after = F.floor((F.col("no") + OVERLAP - 1) / MESSAGES) + 1
    head = (F.col("no") == F.col("system_no")) & (after <= F.col("last"))
    overlap = (F.col("own") < F.col("last")) & ((F.col("no") - 1) % MESSAGES >= MESSAGES - OVERLAP)
    none = F.array().cast("array<bigint>")
    again = F.array_union(F.when(overlap, F.array(F.col("own") + 1)).otherwise(none),
                          F.when(head, F.sequence(after, F.col("last"))).otherwise(none))
    parts = F.concat(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("again"))),
                     F.transform(again, lambda p: F.struct(p.alias("part"), F.lit(True).alias("again"))))
    return rows.select("conv_id", "no", "speaker", "text", F.inline(parts))


def messages(conversations: DataFrame) -> DataFrame:
    """One row per dialogue, participant, part and message: conv_id, perspective, part, no, speaker, role, text,
    rendered, trained, text_at.

    The participant is the assistant, whose messages are trained on once, and all others are users named by their
    role. A system message belongs to nobody: it keeps its role and is shown to every participant. A dialogue without
    any other speaker is shown once, with perspective null. Null roles speak as "unknown", null texts are empty,
    messages without conv_id are one dialogue, those without turn come first, equal turns are ordered by speaker and
    text, and repeated rows are kept. Empty input gives no rows; other columns are ignored.
    """
    sides = _said(conversations).where("speaker <> 'system'").groupBy("conv_id").agg(
        F.array_sort(F.collect_set("speaker")).alias("sides"))
    joined = join_on(dealt(conversations), sides, ["conv_id"], "left")
    each = joined.select("conv_id", F.explode_outer("sides").alias("perspective"), "part", "no", "again", "speaker", "text")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    role = F.when(own, "assistant").when(F.col("speaker") == "system", "system").otherwise("user")
    return each.withColumns({"role": role, "trained": own & ~F.col("again")}).withColumn(
        "header", _header(F.col("role"), F.col("speaker"))).select(
        "conv_id", "perspective", "part", "no", "speaker", "role", "text",
        F.concat("header", "text", F.lit(END)).alias("rendered"), "trained",
        F.char_length("header").alias("text_at"))


def examples(conversations: DataFrame) -> DataFrame:
    """Rendered dialogues: one row per dialogue, participant and part of MESSAGES messages.

    Columns: conv_id, perspective, part (from 0), n_messages, rendered, mask. mask has [start, end) of what is trained
    on, in characters of rendered: the participant's own messages with their end marks, but not those shown again.
    A row has at most MESSAGES + OVERLAP + 1 messages, however long the dialogue is; see dealt and messages for
    what a part shows, nulls, ties and empty input.
    """
    message = F.struct("no", "rendered", "trained", "text_at")
    held = messages(conversations).groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list(message)).alias("m"))
    lengths = F.transform("m", lambda x: F.char_length(x["rendered"]).cast("bigint"))
    held = held.withColumn("lengths", lengths).withColumn("at", F.transform(
        F.sequence(F.lit(0), F.size("m") - 1), lambda i: F.aggregate(
            F.slice("lengths", 1, i), F.lit(0).cast("bigint"), lambda total, x: total + x)))
    spans = F.zip_with("m", "at", lambda x, at: F.struct(
        (at + x["text_at"]).alias("start"), (at + F.char_length(x["rendered"])).alias("end"), x["trained"].alias("trained")))
    mask = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["end"]))
    return held.select("conv_id", "perspective", "part", F.size("m").cast("bigint").alias("n_messages"),
                       F.array_join(F.transform("m", lambda x: x["rendered"]), "").alias("rendered"), mask.alias("mask"))
