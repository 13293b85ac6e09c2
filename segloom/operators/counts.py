"""Counts of a segmented corpus, and what is derived from them.

A segmented corpus has columns ``word``, ``segment ARRAY<STRUCT<morph, state>>`` and ``n``, how
often the word is there. Words with a null or empty segment count for nothing. States are 0 (start)
to ``num_state`` - 1 (end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARY = "▁"


def segmented_rows(segmented: DataFrame) -> DataFrame:
    """``segment`` and ``n`` (1 if there is no such column) of the words that have a segment."""
    n = F.col("n") if "n" in segmented.columns else F.lit(1)
    return segmented.where(F.size("segment") > 0).select("segment", n.cast("bigint").alias("n"))


def lexicon(segmented: DataFrame) -> DataFrame:
    """``morph``, ``state``, ``freq``: how often each morph is emitted by each state."""
    emitted = segmented_rows(segmented).select(F.inline("segment"), "n")
    return emitted.groupBy("morph", "state").agg(F.sum("n").alias("freq"))


def paths(segmented: DataFrame, num_state: int) -> DataFrame:
    """``from_state``, ``to_state``, ``n``: each step of each word, from the start to the end."""
    states = F.transform("segment", lambda x: x["state"])
    path = F.concat(F.array(F.lit(0)), states, F.array(F.lit(num_state - 1)))
    steps = F.transform(
        F.sequence(F.lit(1), F.size(states) + 1),
        lambda i: F.struct(
            F.element_at(path, i).cast("int").alias("from_state"),
            F.element_at(path, i + 1).cast("int").alias("to_state"),
        ),
    )
    return segmented_rows(segmented).select(F.inline(steps), "n")


def transitions(segmented: DataFrame, num_state: int) -> DataFrame:
    """``from_state``, ``to_state``, ``freq`` of the steps that occur."""
    return paths(segmented, num_state).groupBy("from_state", "to_state").agg(F.sum("n").alias("freq"))


def grid(df: DataFrame, num_state: int, *names: str) -> DataFrame:
    """All combinations of states under these names; num_state to the power of their number."""
    states = [F.lit(s) for s in range(num_state)]
    out = df.sparkSession.range(1)
    for name in names:
        out = out.withColumn(name, F.explode(F.array(*states)))
    return out.drop("id")


def transition_matrix(freq: DataFrame, num_state: int) -> DataFrame:
    """All num_state x num_state pairs, 0 where no step is. At most num_state^2 rows come in, so they are broadcast."""
    dense = grid(freq, num_state, "from_state", "to_state")
    return dense.join(F.broadcast(freq), ["from_state", "to_state"], "left").select(
        "from_state", "to_state", F.coalesce("freq", F.lit(0)).alias("freq")
    )


def state_freq(segmented: DataFrame, num_state: int) -> DataFrame:
    """``state``, ``freq``: emissions of each state; the start and the end count once a word; 0 for others."""
    starts = F.transform("segment", lambda x: x["state"].cast("int"))
    each = F.concat(F.array(F.lit(0)), starts, F.array(F.lit(num_state - 1)))
    found = segmented_rows(segmented).select(F.explode(each).alias("state"), "n")
    return dense_states(found.groupBy("state").agg(F.sum("n").alias("freq")), num_state)


def dense_states(freq: DataFrame, num_state: int) -> DataFrame:
    """A row for each state, 0 where there is none. At most num_state rows come in, so they are broadcast."""
    return grid(freq, num_state, "state").join(F.broadcast(freq), "state", "left").select(
        "state", F.coalesce("freq", F.lit(0)).alias("freq")
    )


def merge_lexicons(lexicons: DataFrame, *by: str) -> DataFrame:
    """Sum of several lexicons (rows of one frame), by model or whatever ``by`` names.

    Null frequencies add nothing. It combines before the shuffle, so a frequent morph is no hot key.
    """
    return lexicons.groupBy(*by, "morph", "state").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


def merge_states(freqs: DataFrame, *by: str) -> DataFrame:
    """Sum of several state frequencies."""
    return freqs.groupBy(*by, "state").agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("freq"))


def bare(morph: Column, boundary: bool = False) -> Column:
    """The morph without the word boundary at its start."""
    return F.when(F.startswith(morph, F.lit(BOUNDARY)), F.substr(morph, F.lit(2))).otherwise(morph) if boundary else morph


def morph_length(morph: Column, boundary: bool = False) -> Column:
    """Characters of the morph, the boundary not counted."""
    return F.length(bare(morph, boundary))


def states_of_types(lex: DataFrame, num_state: int, boundary: bool = False) -> DataFrame:
    """``state``, ``types``, ``char_size``, ``freq`` of each interior state.

    ``char_size`` is the sum of length + 1 over the distinct morphs; ``freq`` the sum of frequencies.
    """
    found = lex.groupBy("state").agg(
        F.count("*").alias("types"),
        F.sum(morph_length(F.col("morph"), boundary) + 1).alias("char_size"),
        F.sum("freq").alias("freq"),
    )
    inner = grid(lex, num_state, "state").where((F.col("state") > 0) & (F.col("state") < num_state - 1))
    zero = F.lit(0).cast("bigint")
    return inner.join(F.broadcast(found), "state", "left").select(
        "state", *[F.coalesce(c, zero).alias(c) for c in ("types", "char_size", "freq")]
    )


def char_counts(lex: DataFrame, boundary: bool = False) -> DataFrame:
    """``state``, ``ch``, ``count``: characters emitted by each state, each as often as its morphs."""
    chars = lex.select("state", "freq", F.explode(F.split(bare(F.col("morph"), boundary), "")).alias("ch"))
    return chars.where("ch <> ''").groupBy("state", "ch").agg(F.sum("freq").alias("count"))


def lexicon_charset(lex: DataFrame, predefined: DataFrame | None = None, boundary: bool = False) -> DataFrame:
    """``ch``: characters of the morphs, with the predefined ones."""
    chars = lex.select(F.explode(F.split(bare(F.col("morph"), boundary), "")).alias("ch")).where("ch <> ''")
    return (chars if predefined is None else chars.unionByName(predefined.select("ch"))).distinct()


def bits_per_char(chars: DataFrame) -> DataFrame:
    """``bits``: bits that one of the characters, or the end of a morph, takes."""
    size = F.countDistinct("ch")
    return chars.agg(F.ceil(F.log2(size + F.lit(1.0))).cast("bigint").alias("bits"))


def freq_of_freq(lex: DataFrame) -> DataFrame:
    """``freq``, ``types``: how many entries have each frequency."""
    return lex.groupBy("freq").agg(F.count("*").alias("types"))


def morph_states(lex: DataFrame) -> DataFrame:
    """``morph``, ``states``: the inverted index, a map from state to frequency; one entry for each state at most."""
    entries = F.collect_list(F.struct("state", "freq"))
    return lex.groupBy("morph").agg(F.map_from_entries(entries).alias("states"))


def morph_char_counts(lex: DataFrame, boundary: bool = False) -> DataFrame:
    """``morph``, ``ch``, ``k``: how often each character is in each distinct morph."""
    chars = lex.select("morph").distinct().select("morph", F.split(bare(F.col("morph"), boundary), "").alias("cs"))
    each = F.transform(F.array_distinct("cs"), lambda c: F.struct(
        c.alias("ch"), F.size(F.filter("cs", lambda x: x == c)).alias("k")
    ))
    return chars.select("morph", F.inline(each)).where("ch <> ''")
