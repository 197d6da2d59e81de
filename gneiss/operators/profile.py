"""Table, class and cluster profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.clean import finite, quoted


def table_profile(df: DataFrame) -> DataFrame:
    """column, dtype, n_rows, n_missing, n_distinct (missing values not counted), one row per column, from one aggregate."""
    cols = df.dtypes
    value = {c: finite(quoted(c)) if t in ("double", "float") else quoted(c) for c, t in cols}
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(value[c]).alias(f"c{i}") for i, (c, _) in enumerate(cols)],
        *[F.count_distinct(value[c]).alias(f"d{i}") for i, (c, _) in enumerate(cols)],
    )
    each = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c{i}")).alias("n_missing"), F.col(f"d{i}").alias("n_distinct"),
        )
        for i, (c, t) in enumerate(cols)
    ]
    return one.select(F.inline(F.array(*each)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """class, n, weight: n / (classes * n_class), log1p, divided by the largest."""
    sizes = df.filter(quoted(label).isNotNull()).groupBy(quoted(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(0))  # one row per class
    w = F.log1p(F.sum("n").over(all_) / (F.count(F.lit(1)).over(all_) * F.col("n")))
    return sizes.withColumn("w", w).select("class", "n", (F.col("w") / F.max("w").over(all_)).alias("weight"))


def cluster_distribution(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """class, clusters (sorted array), n_rows, balance: the entropy of the cluster sizes over its maximum, 0 with one cluster."""
    sizes = df.groupBy(quoted(label).alias("class"), quoted(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("class")
    p = F.col("n") / F.sum("n").over(by)
    return (
        sizes.withColumn("h", -p * F.ln(p))
        .groupBy("class")
        .agg(
            F.array_sort(F.collect_list("cluster")).alias("clusters"),
            F.sum("n").alias("n_rows"),
            F.sum("h").alias("h"),
            F.count(F.lit(1)).alias("k"),
        )
        .select("class", "clusters", "n_rows", F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0).alias("balance"))
    )
