"""One training step: search, filters, recount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.operators.annealed import annealed_counts
from segloom.operators.counts import BOUNDARY
from segloom.operators.lattice import BROADCAST_ENTRIES, search_words
from segloom.operators.model import Model
from segloom.operators.occurrences import random_counts


def word_of(segment: Column) -> Column:
    """The word that a segment spells, without leading word boundaries."""
    return F.ltrim(F.array_join(F.transform(segment, lambda x: x["morph"]), ""), F.lit(BOUNDARY))


def without_deregistered(segmented: DataFrame, deregistered: DataFrame | None) -> DataFrame:
    """Drops the words that use any of the pairs (``morph``, ``state``).

    Pairs are joined with the distinct words' emissions, so none of the two sides has to be small.
    """
    if deregistered is None:
        return segmented
    pairs = deregistered.select("morph", "state").distinct()
    used = segmented.select("word", F.inline("segment")).join(pairs, ["morph", "state"], "left_semi")
    return segmented.join(used.select("word").distinct(), "word", "left_anti")


def train_step(
    words: DataFrame,
    model: Model,
    temperature: float = 0.0,
    final: bool = False,
    seed: int = 0,
    epoch: int = 0,
    key: str = "word",
    deregistered: DataFrame | None = None,
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """The segmented corpus of one step: ``words`` with ``segment`` and ``cost``.

    ``words`` has ``word``, ``n``, or a key for each occurrence above T = 0, and may have ``segment``
    and ``cost`` of an earlier step, which stay where no path is found; other words without a path
    are dropped, and so are words with a cost of 0 or less or with a de-registered pair. With
    ``final``, only known morphs are used.
    """
    earlier = {"segment", "cost"} <= set(words.columns)
    given = words.withColumnsRenamed({"segment": "_segment", "cost": "_cost"}) if earlier else words
    found = search_words(given, model, not final, temperature, seed, epoch, key, broadcast_entries)
    if earlier:
        found = found.withColumns(
            {
                "cost": F.when(F.col("segment").isNull(), F.col("_cost")).otherwise(F.col("cost")),
                "segment": F.coalesce("segment", "_segment"),
            }
        ).drop("_segment", "_cost")
    return without_deregistered(found.where("segment IS NOT NULL AND cost > 0"), deregistered)


def epoch_counts(
    words: DataFrame,
    model: Model,
    temperature: float = 0.0,
    fraction: float = 0.0,
    seed: int = 0,
    epoch: int = 0,
    deregistered: DataFrame | None = None,
) -> DataFrame:
    """Counts of one epoch over ``word``, ``n``: that share of the occurrences at random, the others searched.

    Which ones are segmented at random is drawn for each occurrence, so a share near ``fraction``
    is, and no sort is needed. Rows of several tasks are to be added.
    """
    searched = annealed_counts(words, model, temperature, fraction, seed, epoch, deregistered)
    if fraction <= 0:
        return searched
    return searched.unionByName(random_counts(words, model.settings, seed, epoch + 1, fraction, epoch))
