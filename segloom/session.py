"""Sessions and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "segloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with; keyword arguments override them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app).config(map=settings)
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set.

    The folder named by ``spark.checkpoint.dir`` is used when there is one. Only a session in
    local mode, where driver and executors are one process, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="segloom-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder so that lost executors cost nothing."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
