"""Preference formatting: a prompt rendered once, and two masked completions.

A pair has a chosen and a rejected conversation. Their longest common turn prefix
(same role and text, turn by turn) is the prompt; what follows in each is its
completion. In a completion only the text of assistant turns is learnt from: the
mask lists their places, as ``start:end`` in code points of the completion.

Everything is DataFrame functions on one row for each conversation and pair.

Defined cases: turns are ordered by number, then role and text, nulls first; a null
role or text counts as empty; repeated turns stay; a pair with one side has an empty
prompt and a null completion and mask for the other; equal conversations are all
prompt, with empty completions; rows without a conversation id belong to no pair;
very long texts are rendered whole; empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, TURN, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text, at) in order; ``at`` is where the turn's rendering begins."""
    clean = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("role") + F.length("text") + F.lit(len(OPEN + TURN + CLOSE))
    placed = clean.withColumn("at", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at"))).alias("turns"))


def _rendered(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{TURN}', t.text, '{CLOSE}')), '')"


def _mask(turns: str) -> str:
    start = f"t.at - {turns}[0].at + length(t.role) + {len(OPEN + TURN)}"
    return f"array_join(transform(filter({turns}, t -> t.role = 'assistant'), t -> concat({start}, ':', {start} + length(t.text))), ',')"


def preference(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, chosen, rejected (arrays of turns, null if missing).

    Gives pair_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    same = "zip_with(chosen, rejected, (a, b) -> a.role = b.role AND a.text = b.text)"
    first = f"array_position(transform({same}, x -> coalesce(x, false)), false)"
    known = "chosen IS NOT NULL AND rejected IS NOT NULL"
    cut = pairs.withColumn("prompt_turns", F.expr(f"CASE WHEN {known} THEN CASE WHEN {first} > 0 THEN {first} - 1 ELSE cast(size(chosen) AS bigint) END ELSE 0L END"))
    tail = lambda c: f"slice({c}, cast(prompt_turns AS int) + 1, size({c}))"
    cut = cut.withColumns({
        "_prompt": F.expr("slice(coalesce(chosen, rejected), 1, cast(prompt_turns AS int))"),
        "_chosen": F.expr(tail("chosen")),
        "_rejected": F.expr(tail("rejected")),
    })
    return cut.select(
        "pair_id", "prompt_turns", F.expr(_rendered("_prompt")).alias("prompt"),
        *(F.expr(_rendered(f"_{c}")).alias(c) for c in ("chosen", "rejected")), *(F.expr(_mask(f"_{c}")).alias(f"{c}_mask") for c in ("chosen", "rejected")),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), k negative too."""
    rows = conversations(turns).select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("good"), "turns")
    return rows.groupBy("pair_id").agg(F.max(F.when(F.col("good"), F.struct("turns")))["turns"].alias("chosen"), F.max(F.when(~F.col("good"), F.struct("turns")))["turns"].alias("rejected"))
