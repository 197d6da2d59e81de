"""Cluster error rates of a stream of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_errors(predictions: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """start, cluster, n_error, n_total, failure_rate per time window; rows later than ``late`` are dropped.

    ``predictions`` (streaming or not): ts, cluster, y, p. Null labels count as errors.
    """
    wrong = (~F.col("y").eqNullSafe(F.col("p"))).cast("bigint")
    rows = predictions.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "cluster")
    out = rows.agg(F.sum(wrong).alias("n_error"), F.count(F.lit(1)).alias("n_total"))
    return out.select(F.col("w.start").alias("start"), "cluster", "n_error", "n_total", (F.col("n_error") / F.col("n_total")).alias("failure_rate"))
