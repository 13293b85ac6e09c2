"""Choosing columns from tables whose other columns are unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, **source: str) -> DataFrame:
    """Columns of ``df`` under new names, ``pick(df, term="morph")`` being ``morph AS term``.

    Names are matched exactly and by position, so further columns may differ from them in letter
    case only, contain dots, or bear the names an operator uses inside. With repeated names the
    first counts.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in source.items()])
