"""Extension: the evidence log as a stream, counted by kind in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import EVIDENCE


def read(spark: SparkSession, path: str) -> DataFrame:
    """New lines of a JSON log folder."""
    return spark.readStream.schema(EVIDENCE).json(path)


def counts(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by window and kind; the watermark bounds the state."""
    d = log.withWatermark("created", late).groupBy(F.window("created", window), "kind").agg(F.count("*").alias("n"))
    return d.select(F.col("window.start").alias("start"), "kind", "n")
