"""Preference formatting of conversations, with DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and
text) is rendered once as prompt; the turns that follow are rendered as two completions, each a list of
pieces with a loss flag that is true for what an assistant says and false for all else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a turn. Fixed values.
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """Text that cannot forge a mark: the opening of a mark is spaced."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _safe(turn["role"]), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(turn["text"]), F.lit(f"{END}\n"))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def pieces(turns: Column, learn: str = "assistant") -> Column:
    """array<struct<text, loss>> of an array of turns: head and body of each."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(_head(t).alias("text"), F.lit(False).alias("loss")),
        F.struct(_body(t).alias("text"), F.coalesce(t["role"] == learn, F.lit(False)).alias("loss")),
    )))


def preference_pairs(turns: DataFrame, *, pair: Column, chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each pair: pair_id, n_prompt_turns, prompt, chosen, rejected, tied.

    ``pair`` names the pair of a turn and ``chosen`` tells which side it is on (null: neither, left
    out, as are turns without a pair). Turns are ordered by ``turn_col`` (nulls first), then role and
    text; repeated rows are one turn; null roles and texts read as empty ones. A side without turns has
    an empty completion; equal sides are ``tied``: all turns are prompt and both completions are empty.
    An empty table gives an empty result; other columns are ignored. One shuffle brings a pair's turns
    together; a rendered pair is one row, so it must fit in one.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("side"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    rows = rows.where("pair_id is not null and side is not null")
    both = rows.groupBy("pair_id").agg(F.sort_array(F.collect_set(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_set(F.when(~F.col("side"), F.col("t")))).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull())
    first = F.array_position(same, F.lit(False))  # from 1; 0 if there is none
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("c")).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        pieces(rest("c")).alias("chosen"), pieces(rest("r")).alias("rejected"), ((F.size("c") == F.col("n")) & (F.size("r") == F.col("n"))).alias("tied"),
    )


def text_of(completion: str) -> Column:
    """The whole text of a completion."""
    return F.array_join(F.transform(completion, lambda p: p["text"]), "")


def mask_of(completion: str) -> Column:
    """The mask of a completion as text: ``loss:characters`` of each piece, comma-joined."""
    return F.array_join(F.transform(completion, lambda p: F.concat(p["loss"].cast("int").cast("string"), F.lit(":"), F.char_length(p["text"]).cast("string"))), ",")
