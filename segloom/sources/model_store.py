"""Models and partitions in folders: a Parquet table for each part, and a JSON manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators.model import Model, Settings

_TABLES = ("lexicon", "state_freq", "transition_freq")


def write_model(model: Model, path: str, corpus: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Writes the model, and the segmented corpus if one is given."""
    s = model.settings
    spark = model.lexicon.sparkSession
    for name in _TABLES:
        getattr(model, name).write.mode(mode).parquet(f"{path}/{name}")
    if corpus is not None:
        corpus.write.mode(mode).parquet(f"{path}/corpus")
    manifest = {
        "num_state": s.num_state, "num_prefix": s.num_prefix, "num_suffix": s.num_suffix,
        "has_word_boundary": s.has_word_boundary, "forbidden": sorted(map(list, s.forbidden)),
        "charset": "".join(sorted(model.predefined)), "corpus": corpus is not None,
    }
    text = spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False),)], "value string")
    text.coalesce(1).write.mode(mode).text(f"{path}/manifest")


def read_model(spark: SparkSession, path: str, build_cache: bool = False) -> tuple[Model, DataFrame | None]:
    """The model and its corpus, if it was written with one. Counts are read, not made again."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    settings = Settings(
        manifest["num_state"], manifest["num_prefix"], manifest["num_suffix"],
        manifest.get("has_word_boundary", False), frozenset(map(tuple, manifest.get("forbidden", ()))),
    )
    lexicon, states, steps = (spark.read.parquet(f"{path}/{name}") for name in _TABLES)
    model = Model(settings, lexicon, states, steps, frozenset(manifest.get("charset", "")))
    corpus = spark.read.parquet(f"{path}/corpus") if manifest.get("corpus") else None
    return (model.with_cache(corpus) if build_cache and corpus is not None else model), corpus


def model_of_segmented_text(
    spark: SparkSession, path: str, settings: Settings, build_cache: bool = False
) -> tuple[Model, DataFrame]:
    """A model counted from a segmented text file, and that corpus."""
    from segloom.sources.segmented_text import read_segmented

    corpus = read_segmented(spark, path)
    model = Model.from_segmented(corpus, settings)
    return (model.with_cache(corpus) if build_cache else model), corpus


def checkpoint_name(name: str, stage: int | str, loss: float) -> str:
    """What a checkpoint is called: stage is the epoch, ``FINAL`` or ``PRUNED``."""
    return f"{name}_{stage}_{loss:.4f}"


def write_partitions(words: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes words by ``pid``, so that a partition can be read alone."""
    words.write.mode(mode).partitionBy("pid").parquet(path)


def read_partition(spark: SparkSession, path: str, pid: int) -> DataFrame:
    """The words of one partition; the filter prunes folders."""
    return spark.read.parquet(path).where(F.col("pid") == pid)


def write_charset(model: Model, path: str, mode: str = "errorifexists") -> None:
    """Writes the distinct characters of all morphs, as ``ch``."""
    model.charset().write.mode(mode).parquet(path)
