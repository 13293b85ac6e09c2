"""Pruning of rare lexicon entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.operators.counts import freq_of_freq


def prune_threshold(lex: DataFrame, min_freq: int, min_remain: int = 0) -> DataFrame:
    """``threshold``: entries of at most this frequency are pruned.

    Going up from 0, it is the first frequency after which no more than ``min_remain`` entries are
    left, but below ``min_freq``. Only frequencies below ``min_freq`` are numbered, not entries.
    """
    rare = freq_of_freq(lex).where((F.col("freq") >= 1) & (F.col("freq") < min_freq))
    steps = lex.sparkSession.range(max(min_freq, 1)).select(F.col("id").alias("freq"))
    total = lex.agg(F.count("*")).scalar()
    gone = F.coalesce(F.sum("types").over(Window.orderBy("freq")), F.lit(0))
    cumulated = steps.join(F.broadcast(rare), "freq", "left").select("freq", (total - gone).alias("left"))
    first = F.min(F.when(F.col("left") <= min_remain, F.col("freq")))
    return cumulated.agg(F.coalesce(first, F.lit(max(min_freq, 1) - 1)).cast("bigint").alias("threshold"))


def pruned_lexicon(lex: DataFrame, min_freq: int, min_remain: int = 0) -> DataFrame:
    """Entries above the threshold."""
    return lex.where(F.col("freq") > prune_threshold(lex, min_freq, min_remain).scalar())
