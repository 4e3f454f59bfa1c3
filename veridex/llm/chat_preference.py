"""Preference formatting: pairs of conversations as one prompt and two masked completions; native expressions only.

The longest common prefix of turns (equal role and text) of the chosen and the rejected conversation is rendered
once as the prompt. What follows it on either side is rendered as that side's completion, together with the
spans (start, length, in code points of the completion) of assistant turns, which alone bear loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _spans(turns: Column, loss_role: str) -> Column:
    """Spans of the turns that bear loss: from after the header to the end of the closing mark."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, turn):
        head = F.char_length(turn["role"]) + F.lit(len(OPEN) + len(MIDDLE))
        body = F.char_length(turn["text"]) + F.lit(len(CLOSE))
        span = F.array(F.struct((acc["at"] + head).cast("int").alias("start"), body.cast("int").alias("length")))
        spans = F.when(turn["role"] == loss_role, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per pair_id: prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans, chosen_id, rejected_id.

    turns: pair_id, side ('chosen' or 'rejected'), conv_id, turn, role, text. Turns are ordered by turn, then role
    and text, nulls first; null role or text reads as empty. A side without turns gives an empty prompt and
    completion; equal conversations give empty completions. Rows with another side are not turns of a pair.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    mine = turns.filter(F.col("side").isin("chosen", "rejected")).select("pair_id", (F.col("side") == "rejected").alias("second"), "conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    pairs = mine.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("second", "turn", "role", "text"))).alias("all"),
        F.min(F.when(~F.col("second"), F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("second"), F.col("conv_id"))).alias("rejected_id"),
    )
    side = lambda second: F.transform(F.filter("all", lambda t: t["second"] == second), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id", side(False).alias("a"), side(True).alias("b"))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size("a"), F.size("b")), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & F.coalesce(F.get("a", i - 1) == F.get("b", i - 1), F.lit(False)), i).otherwise(acc),
    )
    pairs = pairs.withColumn("prompt_turns", same)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    pairs = pairs.withColumns({"head": F.slice("a", F.lit(1), F.col("prompt_turns")), "a": rest("a"), "b": rest("b")})
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("int").alias("prompt_turns"),
        _joined(F.col("head")).alias("prompt"), _joined(F.col("a")).alias("chosen"), _joined(F.col("b")).alias("rejected"),
        _spans(F.col("a"), loss_role).alias("chosen_spans"), _spans(F.col("b"), loss_role).alias("rejected_spans"),
    )


def turns_alone(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The rows of preference_pairs for turns of no known conversation: each is a chosen completion of its own.

    turns: role, text. They are never gathered, so any number of them does no harm.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = turns.select(F.array(F.struct(empty("role").alias("role"), empty("text").alias("text"))).alias("a"))
    none = F.lit(None).cast("bigint")
    return one.select(
        none.alias("pair_id"), none.alias("chosen_id"), none.alias("rejected_id"), F.lit(0).alias("prompt_turns"), F.lit("").alias("prompt"), _joined(F.col("a")).alias("chosen"), F.lit("").alias("rejected"),
        _spans(F.col("a"), loss_role).alias("chosen_spans"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("rejected_spans"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pair conversations 2k (chosen) and 2k + 1 (rejected); every conversation with an id is in one pair."""
    conversations = conversations.filter("conv_id is not null")
    k = F.floor(F.col("conv_id") / 2).cast("long")
    return conversations.select(k.alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 1, "rejected").otherwise("chosen").alias("side"), "conv_id", "turn", "role", "text")
