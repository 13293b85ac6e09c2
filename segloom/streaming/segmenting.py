"""Segmentation of a stream of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from segloom.operators.lattice import search_words
from segloom.operators.model import Model


def segment_stream(words: DataFrame, model: Model) -> DataFrame:
    """``words``, a streaming DataFrame with ``word``, with ``segment`` and ``cost``.

    It keeps no state: each word is searched for itself, with the lexicon broadcast, so a stream may
    run in any output mode. The lexicon has to be small enough for that.
    """
    return search_words(words, model)


def write_stream(segmented: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's segments to Parquet files, each row once."""
    return (
        segmented.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
