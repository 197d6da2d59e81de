"""Summaries over many runs: tables per configuration, importances, lifts, instance and cost comparisons.

A run is a row: config columns (variant, dataset, seed, classifier) and its metrics. All are grouped
aggregates; where groupings share a pass they are grouping sets of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feature families by prefix; fixed values.
FAMILIES = [
    ("feature-overlap", ("f1", "f2", "f3", "f4")),
    ("neighbourhood", ("n1", "n2", "n3", "n4")),
    ("network", ("network_density", "cls_coef", "hub")),
    ("cluster-geometry", ("max_dispersion", "p95_dispersion", "dist_to_nearest_centroid", "p5_silhouette", "frac_at_risk")),
    ("dimensionality", ("t2", "t3", "t4")),
]
#: Classifiers whose results are shown together; fixed values.
MERGED = {"numerical": "mlp", "tabular": "mlp"}


def config_table(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, mean, median, std (sample, 0 for one run), above (share over 0.7), below (share under 0), n; null values left out."""
    v = runs.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return v.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.avg((F.col(value) > 0.7).cast("double")).alias("above"), F.avg((F.col(value) < 0).cast("double")).alias("below"), F.count(F.lit(1)).alias("n"),
    )


def cluster_count_table(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def classifier_and_dataset_table(runs: DataFrame, value: str) -> DataFrame:
    """axis, name, mean, n: both groupings from one scan."""
    clf = F.create_map(*[F.lit(x) for kv in MERGED.items() for x in kv])
    r = runs.withColumn("classifier", F.coalesce(clf[F.col("classifier")], F.col("classifier")))
    g = r.groupingSets([["classifier"], ["dataset"]], "classifier", "dataset").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping("classifier").alias("g"))
    return g.select(F.when(F.col("g") == 0, "classifier").otherwise("dataset").alias("axis"), F.coalesce("classifier", "dataset").alias("name"), "mean", "n")


def lift_table(runs: DataFrame, by: list[str], lift: str, low: str, high: str) -> DataFrame:
    """by, mean and median lift (NaN left out), shares of runs whose interval lies above and below 0."""
    v = F.nanvl(lift, F.lit(None))
    return runs.groupBy(*by).agg(
        F.avg(v).alias("mean_lift"), F.median(v).alias("median_lift"), F.avg((F.col(low) > 0).cast("double")).alias("better"),
        F.avg((F.col(high) < 0).cast("double")).alias("worse"), F.count(v).alias("n"),
    ).withColumn("net", F.col("better") - F.col("worse"))


def family_importance(importances: DataFrame) -> DataFrame:
    """family, level, percent: importances (name, value) rolled up by the name's level prefix and family, as shares of all."""
    level = F.when(F.col("name").startswith("class_"), "class").otherwise("cluster")
    bare = F.regexp_replace("name", "^(cluster|class)_", "")
    family = F.lit("other")
    for name, prefixes in reversed(FAMILIES):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | bare.startswith(p)
        family = F.when(hit, name).otherwise(family)
    per = importances.select(family.alias("family"), level.alias("level"), "value").groupBy("family", "level").agg(F.sum("value").alias("v"))
    total = importances.agg(F.sum("value").alias("t"))
    return per.crossJoin(F.broadcast(total)).select("family", "level", (100 * F.col("v") / F.col("t")).alias("percent"))


def mean_importance(importances: DataFrame, k: int) -> DataFrame:
    """The ``k`` features of the largest mean absolute value."""
    return importances.groupBy("name").agg(F.avg(F.abs("value")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "name").limit(k)


def instance_table(runs: DataFrame, reference: str) -> DataFrame:
    """method, median, mean_delta: medians of each method's value, and the mean over datasets of its mean difference to the reference."""
    ref = runs.filter(F.col("method") == reference).select("run", F.col("value").alias("r"))
    both = runs.join(ref, "run", "left")
    per = both.groupBy("method", "dataset").agg(F.avg(F.col("value") - F.col("r")).alias("d"))
    return both.groupBy("method").agg(F.median("value").alias("median")).join(per.groupBy("method").agg(F.avg("d").alias("mean_delta")), "method")


def cost_quality(runs: DataFrame, timings: DataFrame, quality: str) -> DataFrame:
    """algorithm, distance, dataset, mean and std of quality, build seconds: runs joined with the summed seconds of their build steps."""
    seconds = timings.filter(F.col("function") == "build_knn_graph").groupBy("run").agg(F.sum("duration_s").alias("s"))
    return runs.join(seconds, "run").groupBy("algorithm", "distance", "dataset").agg(
        F.avg(quality).alias("quality"), F.coalesce(F.stddev_samp(quality), F.lit(0.0)).alias("std"), F.avg("s").alias("build_s"), F.count(F.lit(1)).alias("n")
    )


def stage_seconds(timings: DataFrame, inside: list[str]) -> DataFrame:
    """run, inside_s, other_s: seconds of the named functions and of all others."""
    hit = F.col("function").isin(*inside)
    return timings.groupBy("run").agg(F.sum(F.when(hit, F.col("duration_s")).otherwise(0.0)).alias("inside_s"), F.sum(F.when(~hit, F.col("duration_s")).otherwise(0.0)).alias("other_s"))


def cost_model_summary(models: DataFrame) -> DataFrame:
    """distance, alpha, alpha_std, c, r2_min, n, and c relative to cosine's."""
    per = models.groupBy("distance").agg(F.avg("alpha").alias("alpha"), F.coalesce(F.stddev_samp("alpha"), F.lit(0.0)).alias("alpha_std"), F.avg("c").alias("c"), F.min("r2").alias("r2_min"), F.count(F.lit(1)).alias("n"))
    base = per.filter("distance = 'cosine'").select(F.col("c").alias("base"))
    return per.join(F.broadcast(base), F.lit(True), "left").withColumn("c_ratio", F.try_divide("c", "base")).drop("base")


def cost_units(df: DataFrame) -> DataFrame:
    """pairs, pair_features and edges of m points with d features and k neighbours."""
    m = F.col("m").cast("bigint")
    return df.withColumn("pairs", m * (m - 1)).withColumn("pair_features", m * (m - 1) * F.col("d")).withColumn("edges", m * F.col("k"))


def scoreboard(runs: DataFrame, rho: str, lift: str) -> DataFrame:
    """One row: mean correlation, share of at least 0.6, mean lift, runs."""
    return runs.agg(F.avg(rho).alias("mean_rho"), F.avg((F.col(rho) >= 0.6).cast("double")).alias("share_strong"), F.avg(lift).alias("mean_lift"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int = 20) -> DataFrame:
    """bin 1..bins, n; the upper end belongs to the last bin, values outside are left out."""
    v = F.col(value)
    b = F.least(F.lit(bins), F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(bins)))
    return df.filter((v >= lo) & (v <= hi)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pivot_table(runs: DataFrame, row: str, column: str, columns: list[str], value: str) -> DataFrame:
    """One row per ``row``, one column of means per given value, and the number of empty cells."""
    out = runs.groupBy(row).pivot(column, columns).agg(F.avg(value))
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return out.withColumn("n_empty", empty)


def base_vs_extended(base: DataFrame, extended: DataFrame) -> DataFrame:
    """pos, delta: extended minus base of two arrays, by position."""
    a = base.select("key", F.posexplode("f1").alias("pos", "b"))
    b = extended.select("key", F.posexplode("f1").alias("pos", "e"))
    return a.join(b, ["key", "pos"]).select("key", "pos", (F.col("e") - F.col("b")).alias("delta"))


def select_runs(runs: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns are among the wanted values; None filters nothing."""
    for c, values in wanted.items():
        if values is not None:
            runs = runs.filter(F.col(c).isin(*(values if isinstance(values, (list, tuple, set)) else [values])))
    return runs
