"""Durable intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
