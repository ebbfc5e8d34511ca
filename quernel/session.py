"""Sessions, tables and the folder that cuts lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quernel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # A checkpoint's files go with the frame that was checkpointed.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; the scan stays lazy, so filters and columns are pushed into it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is configured (tests on one machine) is a local one taken.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return configured or os.path.join(tempfile.gettempdir(), "quernel-checkpoints")


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is left to a shuffled join.

    Only up to most + 1 rows are counted, and none is dropped.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by definition, collected only up to ``most`` of them.

    Raises ValueError beyond it, so that no table that grows with the data reaches the driver.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
