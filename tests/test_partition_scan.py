"""Lines of all partitions, each once."""

from __future__ import annotations

from pyspark.sql import SparkSession

from segloom.plans.queries import partition_scan


def test_every_partition(tmp_path):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    rows = [(1, 0, "a"), (2, 1, "b"), (2, 1, "b"), (3, 7, "c")]
    spark.createDataFrame(rows, "line_id bigint, pid int, dataset string").write.parquet(f"{tmp_path}/partition_lines.parquet")
    found = sorted(tuple(r) for r in partition_scan(spark, str(tmp_path)).collect())
    assert found == [(0, 1, "a"), (1, 2, "b"), (7, 3, "c")]
