"""Preference formatting: shared prompt and paired, masked completions.

The longest common turn prefix of the chosen and the rejected conversation is
rendered once as the prompt; what follows in each is its completion, with a
mask that marks assistant turns as trained. All of it is built-in expressions on
two arrays of turns per pair, so a pair is one row and no user function runs.

Turns are gathered in one shuffle keyed by pair; equal first turns or equal
conversations of other pairs do not meet there, so frequent ones are no hot key.

Defined cases: null roles or texts are empty; turns with equal numbers are
ordered by role and text; rows without a conversation id belong to none; a pair
whose sides are equal has a full prompt and empty completions; conversations
without an assistant turn on either side make no pair; repeated rows are repeated
turns; texts of any length are compared and rendered whole; ids of the whole
range of a long pair exactly; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed format of a turn, as in common chat templates.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), "")


def masks(turns: Column, trained: str = "assistant") -> Column:
    """Characters of each rendered turn and whether the loss covers them."""
    frame = len(OPEN + MIDDLE + CLOSE)
    return F.transform(turns, lambda t: F.struct((F.length(t["role"]) + F.length(t["text"]) + frame).cast("long").alias("n_chars"), (t["role"] == trained).alias("train")))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns two conversations share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def formatted(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs with chosen and rejected, arrays of (role, text), replaced by prompt, completions and masks."""
    rest = [c for c in pairs.columns if c not in (chosen, rejected)]
    cut = pairs.withColumn("_n", common_prefix(F.col(chosen), F.col(rejected)))
    tail = lambda c: F.slice(F.col(c), F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
    cut = cut.select(*rest, "_n", F.slice(F.col(chosen), F.lit(1), F.col("_n")).alias("_p"), tail(chosen).alias("_c"), tail(rejected).alias("_r"))
    return cut.select(
        *rest, F.col("_n").alias("n_prompt_turns"), rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_c")).alias("chosen"), masks(F.col("_c")).alias("chosen_mask"), rendered(F.col("_r")).alias("rejected"), masks(F.col("_r")).alias("rejected_mask"),
    )


def swapped_responses(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with the last assistant turn of its neighbour (id 2k and 2k + 1) in place of its own."""
    clean = turns.where(F.col(conv_id).isNotNull()).select(
        F.shiftright(F.col(conv_id).cast("long"), 1).alias("pair"), F.struct(F.col(conv_id).alias("id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    both = clean.groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias("all"))
    side = lambda k: F.filter("all", lambda t: F.pmod(t["id"], F.lit(2)) == k)
    sides = both.select(side(0).alias("a"), side(1).alias("b"))
    each = sides.select(F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("p")).select("p.*")
    found = each.select(
        "own",
        F.array_max(F.transform("own", lambda t, i: F.when(t["role"] == "assistant", i))).alias("at"),
        F.get(F.reverse(F.filter("other", lambda t: t["role"] == "assistant")), 0)["text"].alias("answer"),
    ).where("at is not null and answer is not null")
    turn = lambda t, text: F.struct(t["role"].alias("role"), text.alias("text"))
    return found.select(
        F.get("own", 0)["id"].alias("conv_id"),
        F.transform("own", lambda t: turn(t, t["text"])).alias("chosen"),
        F.transform("own", lambda t, i: turn(t, F.when(i == F.col("at"), F.col("answer")).otherwise(t["text"]))).alias("rejected"),
    )
