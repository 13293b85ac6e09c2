"""Frequencies of all terms, and the most frequent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A term is spread over so many sub-partitions, by the hash of its record.
SALTS = 16


def once(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of equal ``key`` once, with the smallest values of the other columns.

    It aggregates before it shuffles, so copies of one row don't travel.
    """
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*key, *[F.col("_least").getField(c).alias(c) for c in rest])


def last_seen(rows: DataFrame, terms: list[str], record: str, weight: Column, salts: int = SALTS) -> DataFrame:
    """Occurrences and records of each term, by last-seen counters.

    Rows are hash-partitioned by the term and a salt, which is a hash of the record, and ordered by
    record. A counter goes over each term's rows and adds 1 to ``records`` whenever the record
    isn't the one seen last; no set of records is kept. As a record lies in one salt only, the
    counters of the salts add up, and a term that has a third of all rows is counted by ``salts``
    tasks. Columns: the terms, ``occurrences``, ``records`` and ``last_record``, the largest.

    A null term is a term; a null record adds to ``occurrences`` only; a null weight adds nothing.
    """
    salted = rows.select(
        *terms, F.col(record).alias("_record"), F.coalesce(weight, F.lit(0)).alias("_weight"),
        F.pmod(F.xxhash64(F.col(record)), F.lit(salts)).alias("_salt"),
    )
    seen = F.lag("_record").over(Window.partitionBy(*terms, "_salt").orderBy("_record"))
    new = F.col("_record").isNotNull() & ~F.col("_record").eqNullSafe(F.col("_seen"))
    counters = (
        salted.withColumn("_seen", seen)
        .groupBy(*terms, "_salt")
        .agg(
            F.sum("_weight").alias("occurrences"),
            F.sum(new.cast("bigint")).alias("records"),
            F.max("_record").alias("last_record"),
        )
    )
    return counters.groupBy(*terms).agg(
        F.sum("occurrences").alias("occurrences"),
        F.sum("records").alias("records"),
        F.max("last_record").alias("last_record"),
    )


def marked(counts: DataFrame, n_records: Column, rare_below: int = 5, common_share: float = 0.5) -> DataFrame:
    """``counts`` with the flags ``rare`` (total below the bound) and ``common`` (in that share of the records)."""
    return counts.withColumns(
        {
            "rare": F.col("occurrences") < rare_below,
            "common": (F.col("records") > 0) & (F.col("records") >= n_records * common_share),
        }
    )


def top_k(rows: DataFrame, item: str, weight: Column, k: int = 20) -> DataFrame:
    """The ``k`` items of highest total weight, ties to the smaller item; exact.

    A hash aggregation that combines before the shuffle and may spill, a top-k of each partition,
    and one final ordered limit: no task sees more than a partition's distinct items, and the last
    one sees ``k`` of each partition. Null and empty items count for nothing.
    """
    return (
        rows.where(F.col(item).isNotNull() & (F.col(item) != ""))
        .groupBy(item)
        .agg(F.sum(weight).alias("occurrences"))
        .orderBy(F.col("occurrences").desc(), F.col(item))
        .limit(k)
    )


def top_n_in_groups(rows: DataFrame, groups: list[str], order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with ``rank`` from 1.

    ``order`` has to end with an identifier. The rank filter becomes a group limit, which keeps at
    most ``n`` rows of a group in each map task, so a group of millions sends few rows to its
    reducer. A null group is a group.
    """
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)
