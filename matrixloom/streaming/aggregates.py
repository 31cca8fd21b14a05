"""The commutative aggregates over a stream of measurements (feature_id, cell_id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detected(stream: DataFrame, by: str = "cell_id", detection_limit: float = 0) -> DataFrame:
    """Running (key, n) of stored values above the limit; use output mode complete or update."""
    return stream.groupBy(by).agg(F.count_if(F.col("value") > detection_limit).alias("n"))


def running_totals(stream: DataFrame, by: str = "cell_id") -> DataFrame:
    """Running (key, total); use output mode complete or update."""
    return stream.groupBy(by).agg(F.sum("value").alias("total"))


def windowed_totals(stream: DataFrame, time: str, width: str, late: str, by: str = "cell_id") -> DataFrame:
    """(window start, key, total, n) per tumbling window; rows later than ``late`` are dropped by the watermark."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), by)
    return w.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "total", "n")
