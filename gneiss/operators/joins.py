"""Joins of samples, clusters and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.clean import quoted


def attach_features(df: DataFrame, features: DataFrame, on: str, exclude: tuple[str, ...] = ("cluster_class",)) -> DataFrame:
    """Left join of the features by ``on``; columns of ``df`` that they replace are dropped first, whatever their case."""
    new = [c for c in features.columns if c != on and c not in exclude]
    lower = {c.lower() for c in new}
    kept = df.select(*[quoted(c) for c in df.columns if c == on or c.lower() not in lower])
    return kept.join(features.select(quoted(on), *[quoted(c) for c in new]), on, "left")


def cluster_summary(clusters: DataFrame, classes: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per cluster: its own measures as ``cluster_*``, its class's as ``class_*``, its errors.

    ``clusters``: cluster, cluster_class and measures; ``classes``: class and measures; ``errors``: cluster,
    n_total, failure_rate. Without errors n_test is 0 and the rate null.
    """
    own = clusters.select(
        "cluster", "cluster_class", *[quoted(c).alias(f"cluster_{c}") for c in clusters.columns if c not in ("cluster", "cluster_class")]
    )
    up = classes.select(F.col("class").alias("cluster_class"), *[quoted(c).alias(f"class_{c}") for c in classes.columns if c != "class"])
    return (
        own.join(up, "cluster_class", "left")
        .join(errors.select("cluster", "n_total", "failure_rate"), "cluster", "left")
        .withColumn("n_test", F.coalesce("n_total", F.lit(0)))
        .drop("n_total")
    )


def lookup_rate(df: DataFrame, rates: DataFrame, on: str) -> DataFrame:
    """``rate`` by key, the mean of all rates where the key is unknown."""
    mean = rates.agg(F.avg("rate").alias("_mean"))
    return df.join(rates.select(on, "rate"), on, "left").crossJoin(F.broadcast(mean)).withColumn("rate", F.coalesce("rate", "_mean")).drop("_mean")


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows without a match; rows with a null id stay."""
    return df.join(ids.select(on), on, "left_anti")
