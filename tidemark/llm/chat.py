"""Preference pairs rendered for training.  DataFrame and SQL functions only.

The longest common turn prefix of a chosen and a rejected conversation is
rendered once as the prompt; what follows in each is its completion.  The mask
of a completion lists the character spans that count for the loss: the content
of assistant turns with its end mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
END_MARK = len(CLOSE.rstrip("\n"))


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def _mask(turns):
    """start-end of each span, comma separated; ends are exclusive."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, t):
        head = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        body = head + F.length(t["text"])
        span = F.concat_ws("-", head.cast("string"), (body + END_MARK).cast("string"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((body + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair_id of ``turns`` (pair_id, chosen, turn, role, text).

    Returns pair_id, n_prefix_turns, n_chosen_turns, n_rejected_turns, prompt,
    chosen, rejected, chosen_mask, rejected_mask.  Turns go by number, nulls
    first, then role and text; null roles and texts are empty.  A side without
    turns has an empty completion, and then the prompt is empty too.  Rows with
    a null pair_id belong to no pair and are left out.  One pair is one output
    row, so its turns meet in one task by the nature of the result.
    """
    none = F.lit("")
    rows = turns.where("pair_id is not null").select("pair_id", "chosen", F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).alias("t"))
    side = lambda flag: F.sort_array(F.collect_list(F.when(F.col("chosen") == flag, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side(True).alias("c"), side(False).alias("r"))
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), n), F.slice("r", F.lit(1), n), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first = F.array_position(same, False)
    pairs = pairs.withColumn("n_prefix_turns", F.when(first == 0, n.cast("long")).otherwise(first - 1))
    rest = lambda s: F.slice(s, (F.col("n_prefix_turns") + 1).cast("int"), F.size(s))
    pairs = pairs.select("*", F.slice("c", F.lit(1), F.col("n_prefix_turns").cast("int")).alias("p"), rest("c").alias("cc"), rest("r").alias("rr"))
    return pairs.select(
        "pair_id",
        "n_prefix_turns",
        F.size("cc").cast("long").alias("n_chosen_turns"),
        F.size("rr").cast("long").alias("n_rejected_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("cc")).alias("chosen"),
        _render(F.col("rr")).alias("rejected"),
        _mask(F.col("cc")).alias("chosen_mask"),
        _mask(F.col("rr")).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: conversation 2k is chosen over 2k + 1; turns of a null ``conv_id`` are of no pair."""
    return conversations.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


def reanswered(conversations: DataFrame) -> DataFrame:
    """Pairs that share their turns up to the last answer: each conversation is chosen over itself with the last answer of its neighbour.

    The neighbour of conversation 2k is 2k + 1, and that of 2k + 1 is 2k; where it has
    no answer the rejected one is empty.  Turns behind the last answer are of the
    chosen side only.  Conversations without an answer, and a null ``conv_id``, are
    of no pair.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant' and pair_id is not null").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("own"))
    both = turns.join(last, "pair_id")
    other = last.select((F.col("pair_id") + 1 - 2 * F.pmod("pair_id", F.lit(2))).alias("pair_id"), F.col("own.text").alias("text"))
    chosen = both.select("pair_id", F.lit(True).alias("chosen"), "turn", "role", "text")
    before = both.where("turn < own.turn or turn is null and own.turn is not null").select("pair_id", F.lit(False).alias("chosen"), "turn", "role", "text")
    answer = last.join(other, "pair_id", "left").select("pair_id", F.lit(False).alias("chosen"), F.col("own.turn").alias("turn"), F.lit("assistant").alias("role"), "text")
    return chosen.union(before).union(answer)
