"""Classification, failure-rate and regression metrics from grouped counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proba_risks(p: Column) -> dict[str, Column]:
    """mcp, margin and entropy risk of an array of class probabilities."""
    top = F.sort_array(p, asc=False)
    clipped = F.transform(p, lambda v: F.least(F.greatest(v, F.lit(1e-12)), F.lit(1.0)))
    return {
        "mcp_risk": 1 - F.array_max(p),
        "margin_risk": 1 - (F.get(top, F.lit(0)) - F.get(top, F.lit(1))),
        "entropy_risk": -F.aggregate(clipped, F.lit(0.0), lambda s, v: s + v * F.ln(v)),
    }


def confusion(pred: DataFrame) -> DataFrame:
    """y, p, n, share of the row."""
    counts = pred.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def class_metrics(pred: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 over the labels of truth and prediction; undefined values are 0."""
    counts = pred.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    true = counts.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))).alias("hit"))
    said = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    both = true.join(said, "class", "full").select(
        "class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hit", "predicted")]
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide("hit", "predicted"), zero)
    recall = F.coalesce(F.try_divide("hit", "support"), zero)
    out = both.select("class", "support", precision.alias("precision"), recall.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return out.withColumn("f1", f1)


def overall_metrics(pred: DataFrame) -> DataFrame:
    """One row: accuracy, macro and support-weighted precision, recall and F1; macro over all labels."""
    per = class_metrics(pred)
    total = F.sum("support")
    agg = [(F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        agg += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / total).alias(f"{m}_weighted")]
    return per.agg(*agg)


def micro_metrics(pred: DataFrame, eps: float = 1e-10) -> DataFrame:
    """One row: micro precision, recall and F1 with ``eps`` in the denominators, and the macro F1 over classes with support."""
    per = class_metrics(pred)
    hit = F.sum(F.col("recall") * F.col("support"))
    said = pred.agg(F.count("p").alias("said"))
    sums = per.agg(hit.alias("hit"), F.sum("support").alias("support"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("f1_macro_present"))
    r = sums.crossJoin(said)
    p, q = F.col("hit") / (F.col("said") + eps), F.col("hit") / (F.col("support") + eps)
    return r.select(p.alias("precision_micro"), q.alias("recall_micro"), (2 * p * q / (p + q + eps)).alias("f1_micro"), "f1_macro_present")


def cluster_errors(pred: DataFrame, scores: tuple[str, ...] = ()) -> DataFrame:
    """cluster, n_error, n_total, failure_rate and the mean of each score."""
    wrong = F.sum((F.col("y") != F.col("p")).cast("bigint"))
    n = F.count(F.lit(1))
    return pred.groupBy("cluster").agg(
        wrong.alias("n_error"), n.alias("n_total"), (wrong / n).alias("failure_rate"), *[F.avg(s).alias(s) for s in scores]
    )


def class_report(pred: DataFrame, confidence: str) -> DataFrame:
    """class, n_total, n_failed, failure_rate, mean_confidence, clusters_tp (sorted), clusters_fn (map predicted -> sorted clusters)."""
    ok = F.col("y") == F.col("p")
    base = pred.groupBy(F.col("y").alias("class")).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~ok).alias("n_failed"),
        F.avg((~ok).cast("double")).alias("failure_rate"),
        F.avg(confidence).alias("mean_confidence"),
        F.array_sort(F.collect_set(F.when(ok, F.col("cluster")))).alias("clusters_tp"),
    )
    fn = pred.filter(~ok).groupBy(F.col("y").alias("class"), "p").agg(F.array_sort(F.collect_set("cluster")).alias("clusters"))
    maps = fn.groupBy("class").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("p").cast("string"), "clusters")))).alias("clusters_fn"))
    return base.join(maps, "class", "left")


def distribution(df: DataFrame, c: str) -> DataFrame:
    """One row: min, p25, median, p75, p90, max, mean, pct_zero of a column; nulls are left out."""
    q = F.percentile(c, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9)]))
    one = df.agg(
        F.min(c).alias("min"), q.alias("q"), F.max(c).alias("max"), F.avg(c).alias("mean"),
        F.avg(F.when(F.col(c).isNotNull(), (F.col(c) == 0).cast("double"))).alias("pct_zero"),
    )
    names = ("p25", "median", "p75", "p90")
    return one.select("min", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)], "max", "mean", "pct_zero")


def average_rank(c: str, *by: str) -> Column:
    """Rank from 1, ties share their mean rank."""
    w, same = Window.partitionBy(*by).orderBy(c), Window.partitionBy(*by, c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def correlation_p_value(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""
    if rho is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    x = 1 - rho * rho  # the share df / (df + t^2)
    a, b = (n - 2) / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def agreement(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, spearman, p_value, r2, mae of two columns; rows with a null are left out. For tables of clusters."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).select(F.col(truth).alias("y"), F.col(guess).alias("g"))
    ranked = rows.withColumn("ry", average_rank("y")).withColumn("rg", average_rank("g"))
    mean = rows.agg(F.avg("y").alias("m"))
    one = ranked.crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr("ry", "rg").alias("spearman"),
        F.sum(F.pow(F.col("y") - F.col("g"), 2)).alias("sse"),
        F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("sst"),
        F.avg(F.abs(F.col("y") - F.col("g"))).alias("mae"),
    )

    def with_p(it):
        for pdf in it:
            pdf["p_value"] = [correlation_p_value(r, int(n)) for r, n in zip(pdf["spearman"], pdf["n"])]
            yield pdf

    out = one.mapInPandas(with_p, "n bigint, spearman double, sse double, sst double, mae double, p_value double")
    return out.select("n", "spearman", "p_value", (1 - F.try_divide("sse", "sst")).alias("r2"), "mae")


def weighted_failure(df: DataFrame) -> DataFrame:
    """One row from cluster rows (n_total, failure_rate, is_noise): global error, noise share, counts of excluded clusters."""
    n = F.sum("n_total")
    return df.agg(
        (F.sum(F.col("failure_rate") * F.col("n_total")) / n).alias("global_error"),
        (F.sum(F.when(F.col("is_noise"), F.col("n_total")).otherwise(0)) / n).alias("noise_share"),
        F.count_if(F.coalesce("n_total", F.lit(0)) == 0).alias("n_untested"),
        F.count_if("is_noise").alias("n_noise"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.count_if(F.col("failure_rate") > 0).alias("n_failing"),
    )


def power_law(df: DataFrame, size: str, seconds: str) -> DataFrame:
    """One row: alpha, c, r2, n_points of seconds = c * size^alpha; the last row of each size counts, below 3 sizes all are null."""
    pts = df.filter(F.col(size).isNotNull() & (F.col(seconds) > 0)).select(F.ln(size).alias("x"), F.ln(seconds).alias("y"))
    one = pts.agg(F.regr_slope("y", "x").alias("alpha"), F.exp(F.regr_intercept("y", "x")).alias("c"), F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n_points"))
    ok = F.col("n_points") >= 3
    return one.select(*[F.when(ok, F.col(c)).alias(c) for c in ("alpha", "c", "r2")], "n_points")


def binned_trend(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """bin, n, mean, std (population): ``y`` over equal logarithmic bins of a positive ``x``."""
    pts = df.filter((F.col(x) > 0) & F.col(y).isNotNull()).select(F.ln(x).alias("lx"), F.col(y).alias("y"))
    span = pts.agg(F.min("lx").alias("lo"), F.max("lx").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("lx") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))
    at = F.when(F.col("hi") > F.col("lo"), at).otherwise(0)
    return pts.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")
    )
