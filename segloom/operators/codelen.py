"""Prequential code length of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.mathx import lgamma, lgamma2
from segloom.operators.costs import PRIOR
from segloom.operators.counts import bits_per_char, lexicon_charset, morph_length


def transition_length(matrix: DataFrame, num_state: int) -> DataFrame:
    """``transition``: bits of all steps, from a dense matrix; the step from start to end is none."""
    used = matrix.where(
        (F.col("from_state") < num_state - 1)
        & (F.col("to_state") > 0)
        & ~((F.col("from_state") == 0) & (F.col("to_state") == num_state - 1))
    )
    each = used.groupBy("from_state").agg(
        F.sum(lgamma2(F.lit(PRIOR)) - lgamma2(F.col("freq") + PRIOR)).alias("steps"),
        F.greatest(F.sum("freq"), F.lit(1)).alias("total"),
        F.count("*").alias("kinds"),
    )
    return each.agg(
        F.coalesce(
            F.sum(F.col("steps") + lgamma2(F.col("total")) - lgamma2(F.col("kinds") * PRIOR)), F.lit(0.0)
        ).alias("transition")
    )


def lexicon_length(lex: DataFrame, boundary: bool = False) -> DataFrame:
    """``lexicon``: bits of all morphs, each with its end."""
    bits = bits_per_char(lexicon_charset(lex, boundary=boundary)).scalar()
    size = F.sum(morph_length(F.col("morph"), boundary) + 1)
    return lex.agg((F.coalesce(size, F.lit(0)) * bits).cast("double").alias("lexicon"))


def emission_length(lex: DataFrame) -> DataFrame:
    """``emission``: length of all emissions; it is in nats, unlike the other parts."""
    each = lex.groupBy("state").agg(
        F.sum(lgamma(F.lit(PRIOR)) - lgamma(F.col("freq") + PRIOR)).alias("morphs"),
        F.sum("freq").alias("total"),
        F.count("*").alias("types"),
    )
    rest = (
        lgamma(F.col("total") + F.col("types") * PRIOR)
        - lgamma(F.col("types") * PRIOR)
        - lgamma(F.col("types") + 1)
    )
    return each.agg(F.coalesce(F.sum(F.col("morphs") + rest), F.lit(0.0)).alias("emission"))


def code_length(lex: DataFrame, matrix: DataFrame, num_state: int, boundary: bool = False) -> DataFrame:
    """One row of ``lexicon``, ``emission``, ``transition`` and their sum ``total``."""
    parts = lexicon_length(lex, boundary).select(
        "lexicon",
        emission_length(lex).scalar().alias("emission"),
        transition_length(matrix, num_state).scalar().alias("transition"),
    )
    return parts.withColumn("total", F.col("lexicon") + F.col("emission") + F.col("transition"))
