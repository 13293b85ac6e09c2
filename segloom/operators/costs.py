"""Cost tables of a model, in bits, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.mathx import INF, log_gamma_change
from segloom.operators.counts import char_counts, lexicon_charset, morph_char_counts, morph_length, states_of_types

PRIOR = 0.5
#: The longest morph that a search considers.
MORPH_SIZE = 8
#: What an unseen character counts as.
UNSEEN = 2


def interior(num_state: int) -> Column:
    """An array of the states between start and end."""
    return F.array(*[F.lit(s) for s in range(1, num_state - 1)])


def transition_costs(
    matrix: DataFrame, states: DataFrame, num_state: int, control: DataFrame | None = None
) -> DataFrame:
    """``from_state``, ``to_state``, ``cost`` of all steps; infinite where ``control`` has ``allowed`` = 0.

    A step that ``control`` doesn't name, or that has null there, is allowed. All tables have at
    most num_state^2 rows, so they are broadcast.
    """
    total = F.col("sf") + (num_state - 2) * PRIOR
    out = matrix.join(
        F.broadcast(states.select(F.col("state").alias("from_state"), F.col("freq").alias("sf"))), "from_state"
    )
    cost = -F.log2((F.col("freq") + PRIOR) / total)
    if control is not None:
        rules = control.groupBy("from_state", "to_state").agg(F.min("allowed").alias("allowed"))
        out = out.join(F.broadcast(rules), ["from_state", "to_state"], "left")
        cost = F.when(F.coalesce("allowed", F.lit(1)) == 0, F.lit(INF)).otherwise(cost)
    return out.select("from_state", "to_state", cost.alias("cost"))


def emission_costs(lex: DataFrame, states: DataFrame) -> DataFrame:
    """``morph``, ``state``, ``cost`` of the lexicon's entries. ``states``: as of ``states_of_types``, a row a state."""
    sized = lex.join(F.broadcast(states.select("state", F.col("freq").alias("sf"), "types")), "state")
    cost = -F.log2((F.col("freq") + PRIOR) / (F.col("sf") + F.col("types") * PRIOR))
    return sized.select("morph", "state", cost.alias("cost"))


def added_chars(states: DataFrame, charset_size: int | Column) -> DataFrame:
    """``state``, ``length``, ``cost``: what the characters of a new morph of that length add to a state."""
    size = charset_size if isinstance(charset_size, Column) else F.lit(charset_size)
    lengths = states.select(
        "state", "char_size", F.explode(F.sequence(F.lit(0), F.lit(MORPH_SIZE))).alias("length")
    )
    base = F.col("char_size") + (size + 1) * PRIOR
    return lengths.select("state", "length", log_gamma_change(base, F.col("length") + 1).alias("cost"))


def added_counts(lex: DataFrame, chars: DataFrame, num_state: int, boundary: bool = False) -> DataFrame:
    """``state``, ``ch``, ``k``, ``cost``: what k more of a character take from it, for k up to the longest morph.

    A row for every state, character and k: states times characters, both bounded, never the words.
    """
    counts = char_counts(lex, boundary)
    every = chars.select("ch", F.explode(interior(num_state)).alias("state"))
    found = every.join(counts, ["state", "ch"], "left").select(
        "state", "ch", F.coalesce("count", F.lit(UNSEEN)).alias("count"),
        F.explode(F.sequence(F.lit(0), F.lit(MORPH_SIZE))).alias("k"),
    )
    return found.select("state", "ch", "k", log_gamma_change(F.col("count") + PRIOR, F.col("k")).alias("cost"))


def added_types(states: DataFrame) -> DataFrame:
    """``state``, ``cost``: what one more morph takes from it."""
    return states.select("state", F.log2(F.col("types") + PRIOR).alias("cost"))


def new_morph_costs(
    morphs: DataFrame, lex: DataFrame, states: DataFrame, num_state: int, boundary: bool = False
) -> DataFrame:
    """``morph``, ``state``, ``cost`` of each of the morphs in each state that doesn't have it yet.

    ``morphs`` has a column ``morph``, of at most MORPH_SIZE characters. Each morph is exploded by its
    characters and joined with the counts of the states, which are as many as states times characters.
    """
    chars = lexicon_charset(lex, boundary=boundary)
    size = chars.agg(F.count("*")).scalar()
    wanted = morphs.select("morph").distinct().select("morph", F.explode(interior(num_state)).alias("state"))
    wanted = wanted.join(lex.select("morph", "state"), ["morph", "state"], "left_anti")
    wanted = wanted.join(F.broadcast(states), "state")
    counts = char_counts(lex, boundary)
    ks = morph_char_counts(morphs, boundary)
    taken = (
        wanted.select("morph", "state")
        .join(ks, "morph")
        .join(F.broadcast(counts), ["state", "ch"], "left")
        .groupBy("morph", "state")
        .agg(
            F.sum(log_gamma_change(F.coalesce("count", F.lit(UNSEEN)) + PRIOR, F.col("k"))).alias("taken")
        )
    )
    length = morph_length(F.col("morph"), boundary)
    added = log_gamma_change(F.col("char_size") + (size + 1) * PRIOR, length + 1)
    base = -F.log2(PRIOR / (F.col("freq") + (F.col("types") + 1) * PRIOR))
    cost = base + added - (F.coalesce("taken", F.lit(0.0)) + F.log2(F.col("types") + PRIOR))
    return wanted.join(taken, ["morph", "state"], "left").select("morph", "state", cost.alias("cost"))


def state_table(lex: DataFrame, states: DataFrame, num_state: int, boundary: bool = False) -> DataFrame:
    """``state``, ``freq`` (as the model has it), ``types``, ``char_size`` of the interior states."""
    types = states_of_types(lex, num_state, boundary).drop("freq")
    return types.join(F.broadcast(states.select("state", "freq")), "state")
