"""Preference formatting: prompt once, then masked chosen and rejected completions.

The turns that a chosen and a rejected conversation share from the start are the prompt.
What follows in either one is its completion, in which only the assistant's turns are
trained on. All steps are DataFrame operations on turns: a conversation of any length is
ranges of rows, never one array.

Nulls: a null role is the role ``unknown``, a null text is empty, and both compare as
such; a null turn sorts first; rows with a null conv_id are one conversation. Repeated
turn numbers are ordered by role and text. Two identical conversations have no
completions; a conversation without partner is chosen, with an empty prompt. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irregts.llm.common import running, sequenced
from irregts.session import materialise

# The marks around a turn (fixed values of the chat format).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """One turn in the chat format; marks inside a text lose their bars."""
    inert = text
    for mark in (OPEN, CLOSE):
        inert = F.replace(inert, F.lit(mark), F.lit(mark.replace("|", "")))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), inert, F.lit(f"{CLOSE}\n"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (0-based), role, text; without nulls in role and text."""
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = sequenced(clean, ["conv_id", "turn", "role", "text"])
    return running(placed, ["conv_id"], name="pos").select("conv_id", "pos", "role", "text")


def neighbour_pairs(numbered: DataFrame) -> DataFrame:
    """Pair conversations that follow each other by (first turn, conv_id).

    Conversations with the same first turn are thus partners. The first of two is the
    chosen one. Every conversation is in one pair; a last one may be alone.
    """
    first = numbered.filter(F.col("pos") == 0).select("conv_id", "role", "text")
    order = running(sequenced(first, ["role", "text", "conv_id"]), [], name="rank")
    pair = F.floor(F.col("rank") / 2).cast("long")
    return order.select("conv_id", pair.alias("pair_id"), (F.col("rank") % 2 == 0).alias("is_chosen"))


def format_preferences(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per rendered turn: prompt turns once, then both completions.

    ``pairs`` has conv_id, pair_id, is_chosen; by default :func:`neighbour_pairs`.
    Columns: pair_id, part (prompt, chosen, rejected), pos (in the conversation), role,
    segment, start (characters of the part ahead of it), n_chars, trained.
    """
    numbered = materialise(numbered_turns(turns), "turns")
    sides = materialise(neighbour_pairs(numbered) if pairs is None else pairs, "pairs")
    sided = numbered.withColumnRenamed("conv_id", "_conv").join(
        sides, F.col("_conv").eqNullSafe(F.col("conv_id"))
    )
    sided = sided.select("pair_id", "is_chosen", "pos", "role", "text")

    # A position is shared if both sides have it and their turns are equal. Digests stand for
    # the turns, so that no text is shuffled for the comparison.
    turn = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    positions = sided.select("pair_id", "pos", turn.alias("turn")).groupBy("pair_id", "pos").agg(
        (F.count(F.lit(1)) == 2).alias("both"), (F.min("turn") == F.max("turn")).alias("same")
    )
    split = F.min(F.when(~(F.col("both") & F.col("same")), F.col("pos")))
    common = positions.groupBy("pair_id").agg(F.coalesce(split, F.max("pos") + 1).alias("common_turns"))

    # Written first, so that the skew join can split a pair of any size.
    joined = sided.join(materialise(common, "prefixes"), "pair_id")
    in_prompt = F.col("pos") < F.col("common_turns")
    part = F.when(in_prompt, "prompt").when(F.col("is_chosen"), "chosen").otherwise("rejected")
    lines = (
        joined.filter(~in_prompt | F.col("is_chosen"))
        .withColumn("part", part)
        .withColumn("trained", (F.col("part") != "prompt") & (F.col("role") == "assistant"))
        .withColumn("segment", rendered(F.col("role"), F.col("text")))
        .withColumn("n_chars", F.length("segment").cast("long"))
        .select("pair_id", "part", "pos", "role", "segment", "n_chars", "trained")
    )
    placed = sequenced(lines, ["pair_id", "part", "pos"])
    return running(placed, ["pair_id", "part"], amount="n_chars", name="start").select(
        "pair_id", "part", "pos", "role", "segment", "start", "n_chars", "trained"
    )


def fold_pairs(lines: DataFrame) -> DataFrame:
    """One row per pair for trainers that read whole strings: prompt, chosen, rejected
    and, per completion, the trained [start, end) spans. Holds one pair in a row, so it
    is for conversations that fit there; :func:`format_preferences` has no such bound."""
    piece = F.struct("pos", "segment", "start", "n_chars", "trained")

    def of(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, piece)))

    packed = lines.groupBy("pair_id").agg(*(of(p).alias(p) for p in ("prompt", "chosen", "rejected")))

    def whole(part: str) -> Column:
        return F.array_join(F.transform(part, lambda x: x["segment"]), "").alias(part)

    def spans(part: str) -> Column:
        trained = F.filter(part, lambda x: x["trained"])
        return F.transform(
            trained, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n_chars"]).alias("end"))
        ).alias(f"{part}_spans")

    return packed.select("pair_id", whole("prompt"), whole("chosen"), whole("rejected"), spans("chosen"), spans("rejected"))
