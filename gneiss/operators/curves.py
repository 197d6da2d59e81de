"""Selective prediction: ordered curves, their summaries, ranks, bins and thresholds.

Curves run over the clusters of a run, tables of a few thousand rows, so an
unpartitioned window is in order; ``curve`` columns keep several curves apart in one plan.
Input order breaks ties and must be given as an ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.metrics import average_rank
from gneiss.plans.order import quantiles, value_places, with_places
from gneiss.plans.scratch import materialize


def risk_coverage(df: DataFrame, *, score: str = "score", rate: str = "rate", support: str = "support", ordinal: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """pos, coverage, accuracy (and ``by``): the most trusted first; nothing where the support adds up to 0."""
    w = Window.partitionBy(*by).orderBy(score, ordinal)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(support).over(Window.partitionBy(*by))
    correct = F.sum((1 - F.col(rate)) * F.col(support)).over(run)
    seen = F.sum(support).over(run)
    out = df.select(*by, F.row_number().over(w).alias("pos"), (seen / total).alias("coverage"), F.try_divide(correct, seen).alias("accuracy"), total.alias("_t"))
    return out.filter("_t > 0").drop("_t")


def macro_recall(df: DataFrame, *, score: str = "score", rate: str = "rate", support: str = "support", ordinal: str = "ordinal", label: str = "class") -> DataFrame:
    """pos, coverage, macro_recall: pooled per class over the admitted clusters, averaged over the classes present."""
    w = Window.orderBy(score, ordinal)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    seq = df.select(
        F.row_number().over(w).alias("pos"), (F.sum(support).over(run) / F.sum(support).over(Window.partitionBy())).alias("coverage"),
        F.col(label).alias("k"), F.col(support).alias("s"), ((1 - F.col(rate)) * F.col(support)).alias("ok"),
    )
    grid = seq.select("pos", "coverage").crossJoin(F.broadcast(df.select(F.col(label).alias("c")).distinct()))
    own = seq.select("pos", "k", "s", "ok")
    full = grid.join(own, "pos").withColumn("s", F.when(F.col("k") == F.col("c"), F.col("s")).otherwise(0)).withColumn("ok", F.when(F.col("k") == F.col("c"), F.col("ok")).otherwise(0.0))
    by = Window.partitionBy("c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    recall = F.try_divide(F.sum("ok").over(by), F.sum("s").over(by))
    return full.select("pos", "coverage", recall.alias("r")).groupBy("pos", "coverage").agg(F.avg("r").alias("macro_recall"))


def curve_summary(curve: DataFrame, value: str, target: float = 0.8, points: int = 101, by: tuple[str, ...] = ()) -> DataFrame:
    """aurc, at_target (and ``by``): linear interpolation on an even coverage grid, held flat before the first and after the last point, and the trapezoid area."""
    w = Window.partitionBy(*by).orderBy("pos")
    seg = curve.select(*by, "pos", F.col("coverage").alias("x0"), F.col(value).alias("y0"), F.lead("coverage").over(w).alias("x1"), F.lead(value).over(w).alias("y1"), F.row_number().over(w).alias("r"))
    step = 1.0 / (points - 1)
    spark = curve.sparkSession
    grid = spark.range(points).select((F.col("id") * step).alias("g"), F.lit(False).alias("t"))
    grid = F.broadcast(grid.union(spark.range(1).select(F.lit(target).alias("g"), F.lit(True).alias("t"))))
    inside = (F.col("g") > F.col("x0")) & ((F.col("g") <= F.col("x1")) | F.col("x1").isNull())
    first = (F.col("r") == 1) & (F.col("g") <= F.col("x0"))
    slope = F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), F.lit(0.0))
    y = F.when(F.col("g") <= F.col("x0"), F.col("y0")).otherwise(F.col("y0") + slope * (F.col("g") - F.col("x0")))
    at = seg.join(grid, first | inside).select(*by, "g", "t", y.alias("y"))
    prev = F.lag("y").over(Window.partitionBy(*by).orderBy("g"))
    area = at.filter("not t").withColumn("a", (F.col("y") + prev) / 2 * step)
    hit = at.filter("t").groupBy(*by).agg(F.max("y").alias("at_target"))
    total = area.groupBy(*by).agg(F.sum("a").alias("aurc"))
    return total.join(hit, list(by)) if by else total.crossJoin(hit)


def selective_metrics(df: DataFrame, guess: str, *, rate: str = "rate", support: str = "support", ordinal: str = "ordinal", target: float = 0.8) -> DataFrame:
    """One row: areas and target values of the predictor's and the oracle's order, the global accuracy, lift and the oracle's benefit recovered (null without headroom)."""
    both = df.select(F.lit("predictor").alias("curve"), F.col(guess).alias("score"), F.col(rate).alias("rate"), F.col(support).alias("support"), F.col(ordinal).alias("ordinal")).union(
        df.select(F.lit("oracle"), rate, rate, support, ordinal)
    )
    s = curve_summary(risk_coverage(both, by=("curve",)), "accuracy", target, by=("curve",))
    return _compared(s, df.agg((1 - F.sum(F.col(rate) * F.col(support)) / F.sum(support)).alias("base")), "accuracy")


def _compared(s: DataFrame, base: DataFrame, what: str) -> DataFrame:
    p = s.filter("curve = 'predictor'").select(F.col("aurc").alias("aurc_predictor"), F.col("at_target").alias("p"))
    o = s.filter("curve = 'oracle'").select(F.col("aurc").alias("aurc_oracle"), F.col("at_target").alias("o"))
    gain = F.col("o") - F.col("base")
    return p.crossJoin(o).crossJoin(base).select(
        F.col("base").alias(f"global_{what}"), "aurc_predictor", "aurc_oracle", F.col("p").alias("at_target_predictor"), F.col("o").alias("at_target_oracle"),
        (F.col("p") - F.col("base")).alias("lift_over_random"), F.when(gain > 1e-9, (F.col("p") - F.col("base")) / gain).alias("oracle_benefit_recovered"),
    )


def selective_recall(df: DataFrame, guess: str, *, target: float = 0.8) -> DataFrame:
    """As selective_metrics on the macro-recall axis. ``df``: rate, support, ordinal, class."""
    s = None
    for name, score in (("predictor", guess), ("oracle", "rate")):
        one = curve_summary(macro_recall(df, score=score), "macro_recall", target).select(F.lit(name).alias("curve"), "aurc", "at_target")
        s = one if s is None else s.union(one)
    per = df.groupBy("class").agg((F.sum((1 - F.col("rate")) * F.col("support")) / F.sum("support")).alias("r"))
    return _compared(s, per.agg(F.avg("r").alias("base")), "recall")


def instance_scores(df: DataFrame, mcp: str, region: str, cluster: str) -> DataFrame:
    """mcp_cluster, combo_rankavg, combo_within added: confidence averaged by cluster, the sum of rank shares, and the region's dense rank with confidence inside it.

    Ranks are global by definition; they come from counts of values, so no task orders all samples. Null scores give null.
    """
    df = materialize(df)
    n = df.count()
    means = df.groupBy(cluster).agg(F.avg(mcp).alias("mcp_cluster"))
    ranked = with_places(df, mcp).withColumn("_m", F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before", "_place")
    ranked = with_places(ranked, region)
    share = F.col("_m") / (n + 1)
    ranked = (
        ranked.withColumn("combo_rankavg", (F.col("_before") + (F.col("_n") + 1) / 2) / (n + 1) + share)
        .withColumn("combo_within", F.col("_place") + share)
        .drop("_m", "_n", "_before", "_place")
    )
    return ranked.join(means, cluster, "left")


def fold_rank(df: DataFrame, value: str, fold: str) -> DataFrame:
    """fold_rank added: (average rank - 1) / (n - 1) in the fold, 0.5 for a single row."""
    n = F.count(F.lit(1)).over(Window.partitionBy(fold))
    return df.withColumn("fold_rank", F.when(n > 1, (average_rank(value, fold) - 1) / (n - 1)).otherwise(0.5))


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin 0.. added: right-closed bins between distinct quantiles, the first also closed on the left; null when fewer than two remain."""
    q = quantiles(df, {value: F.col(value)}, [i / bins for i in range(bins + 1)])[value] or []
    edges = sorted(set(q))
    if len(edges) < 3:
        return df.withColumn("bin", F.lit(None).cast("int"))
    inner = edges[1:-1]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: F.col(value) > e))
    return df.withColumn("bin", F.when(F.col(value).isNotNull(), at))


def atc_threshold(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    """One row: threshold, the confidence below which as many samples lie as are wrong; the least confidence if none is wrong.

    Of n samples in the order of their confidence with w wrong ones, that is the w-th smallest.
    """
    wrong = df.agg(F.greatest(F.count_if(~correct), F.lit(1)).alias("_w"))
    at = value_places(df, confidence).join(F.broadcast(wrong), (F.col("_before") < F.col("_w")) & (F.col("_w") <= F.col("_before") + F.col("_n")))
    return at.agg(F.max(confidence).alias("threshold"))


def atc_cluster_risk(df: DataFrame, confidence: str, correct: Column, cluster: str) -> DataFrame:
    """cluster, atc_risk: share of the cluster's samples below the threshold."""
    t = atc_threshold(df, confidence, correct)
    below = (F.col(confidence) < F.col("threshold")).cast("double")
    return df.crossJoin(F.broadcast(t)).groupBy(cluster).agg(F.avg(below).alias("atc_risk"))


def with_atc_scores(df: DataFrame, confidence: str, correct: Column, region: str, cluster: str) -> DataFrame:
    """atc_cluster and combo_atc_rankavg added: the cluster's share below the threshold, and the sum of its and the region's rank shares."""
    df = materialize(df)
    n = df.count()
    risk = atc_cluster_risk(df, confidence, correct, cluster).withColumnRenamed("atc_risk", "atc_cluster")
    out = df.join(risk, cluster, "left")
    for c in ("atc_cluster", region):
        out = with_places(out, c).withColumn(f"_{c}", (F.col("_before") + (F.col("_n") + 1) / 2) / (n + 1)).drop("_n", "_before", "_place")
    return out.withColumn("combo_atc_rankavg", F.col("_atc_cluster") + F.col(f"_{region}")).drop("_atc_cluster", f"_{region}")


def error_mass_classes(df: DataFrame, label: str, errors: str, share: float = 0.9, least: int = 2) -> DataFrame:
    """class, errors, rank: the classes with most errors until ``share`` of all is covered, ``least`` at least."""
    w = Window.orderBy(F.desc(errors), label)
    before = F.coalesce(F.sum(errors).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(errors).over(Window.partitionBy())
    out = df.select(F.col(label).alias("class"), F.col(errors).alias("errors"), F.row_number().over(w).alias("rank"), before.alias("_b"), total.alias("_t"))
    return out.filter((F.col("rank") <= least) | (F.col("_b") < F.col("_t") * share)).drop("_b", "_t")
