"""Tables that an operator or query uses several times, stored once in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only where none is set, as in tests on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once and stored; the plan starts anew from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
