"""Queries on prediction metrics and selective prediction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import curves, metrics
from gneiss.plans.scratch import table
from gneiss.plans.views import PRED, clu, emb, pred, r6, rounded


def _scored(spark, d):
    p = pred(spark, d)
    return p.select("id", "y", "p", "cluster", *[c.alias(n) for n, c in metrics.proba_risks(F.col("proba")).items()])


def mcp_margin_entropy(spark, d):
    return rounded(_scored(spark, d).drop("cluster"))


def confusion_matrix(spark, d):
    return rounded(metrics.confusion(pred(spark, d)))


def class_metrics(spark, d):
    return rounded(metrics.class_metrics(pred(spark, d)))


def accuracy_macro_weighted(spark, d):
    return rounded(metrics.overall_metrics(pred(spark, d)))


def micro_metrics(spark, d):
    return rounded(metrics.micro_metrics(pred(spark, d)))


def cluster_error_rates(spark, d):
    return rounded(metrics.cluster_errors(_scored(spark, d), ("mcp_risk", "entropy_risk")))


def class_report(spark, d):
    out = metrics.class_report(_scored(spark, d).withColumn("conf", 1 - F.col("mcp_risk")), "conf")
    fn = F.array_join(F.transform(F.map_entries(F.coalesce("clusters_fn", F.expr("map()"))), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";")
    return rounded(out.select("class", "n_total", "n_failed", "failure_rate", "mean_confidence", F.array_join("clusters_tp", ",").alias("clusters_tp"), fn.alias("clusters_fn")))


def failure_rate_distribution(spark, d):
    return rounded(metrics.distribution(clu(spark, d), "rate"))


def weighted_failure(spark, d):
    c = clu(spark, d).select(F.col("support").alias("n_total"), F.col("rate").alias("failure_rate"), (F.col("cluster") % 10 == 3).alias("is_noise"))
    return rounded(metrics.weighted_failure(c))


def spearman(spark, d):
    return rounded(metrics.agreement(clu(spark, d), "rate", "score").drop("p_value"))


def spearman_p_value(spark, d):
    return rounded(metrics.agreement(clu(spark, d), "rate", "score").select("n", "p_value"))


def power_law_fit(spark, d):
    li = table(spark, d, "lineitem")
    pts = li.groupBy((F.col("l_quantity").cast("int")).alias("m")).agg(F.sum("l_extendedprice").alias("t")).select(F.col("m").cast("double").alias("m"), "t")
    return rounded(metrics.power_law(pts, "m", "t"))


def binned_trend(spark, d):
    return rounded(metrics.binned_trend(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 4)


def risk_coverage(spark, d):
    return rounded(curves.risk_coverage(clu(spark, d)))


def macro_recall_curve(spark, d):
    return rounded(curves.macro_recall(clu(spark, d)))


def curve_interp_auc(spark, d):
    return rounded(curves.curve_summary(curves.risk_coverage(clu(spark, d)), "accuracy"))


def selective_metrics(spark, d):
    return rounded(curves.selective_metrics(clu(spark, d), "score"))


def selective_recall(spark, d):
    return rounded(curves.selective_recall(clu(spark, d), "score"))


def rejection_curve(spark, d):
    c = curves.risk_coverage(clu(spark, d))
    return rounded(c.select("pos", (1 - F.col("coverage")).alias("rejected"), (1 - F.col("accuracy")).alias("error")))


def _region(spark, d):
    c = clu(spark, d).select("cluster", F.col("rate").alias("region"))
    return _scored(spark, d).join(c, "cluster").select("id", "y", "p", "cluster", "region", F.round("mcp_risk", 9).alias("mcp"))


def avg_rank_combo(spark, d):
    return rounded(curves.instance_scores(_region(spark, d), "mcp", "region", "cluster").select("id", "mcp_cluster", "combo_rankavg", "combo_within"))


def atc_combo(spark, d):
    s = _region(spark, d).withColumn("conf", 1 - F.col("mcp"))
    return rounded(curves.with_atc_scores(s, "conf", F.col("y") == F.col("p"), "region", "cluster").select("id", "atc_cluster", "combo_atc_rankavg"))


def fold_percentile_rank(spark, d):
    return rounded(curves.fold_rank(_region(spark, d).withColumn("fold", F.col("id") % 5), "mcp", "fold").select("id", "fold", "fold_rank"))


def quantile_bins(spark, d):
    return curves.quantile_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 5)


def atc_threshold(spark, d):
    s = _region(spark, d).withColumn("conf", 1 - F.col("mcp"))
    return rounded(curves.atc_threshold(s, "conf", F.col("y") == F.col("p")))


def atc_cluster_risk(spark, d):
    s = _region(spark, d).withColumn("conf", 1 - F.col("mcp"))
    return rounded(curves.atc_cluster_risk(s, "conf", F.col("y") == F.col("p"), "cluster"))


def error_mass_classes(spark, d):
    per = pred(spark, d).groupBy("y").agg(F.count_if(F.col("y") != F.col("p")).alias("n_error"))
    return curves.error_mass_classes(per, "y", "n_error")


def instance_calibration(spark, d):
    """Mean squared error of the region's rate and of the confidence against failure, and ATC's error of the total rate."""
    s = _region(spark, d).withColumn("wrong", (F.col("y") != F.col("p")).cast("double"))
    atc = curves.atc_cluster_risk(s.withColumn("conf", 1 - F.col("mcp")), "conf", F.col("wrong") == 0, "cluster")
    j = s.join(atc, "cluster")
    sq = lambda c: F.avg(F.pow(F.col(c) - F.col("wrong"), 2))
    return rounded(j.agg(sq("region").alias("mse_region"), sq("mcp").alias("mse_mcp"), F.abs(F.avg("atc_risk") - F.avg("wrong")).alias("atc_abs_error")))


def top_failing_clusters(spark, d):
    return rounded(clu(spark, d).orderBy(F.desc("rate"), "cluster").limit(10).select("cluster", "class", "support", "rate"))


def class_order_by_failure(spark, d):
    c = clu(spark, d).groupBy("class").agg(F.median("rate").alias("median_rate"), F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col("rate") > 0).alias("n_failing"))
    return rounded(c.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("median_rate"), "class"))))


def squared_error_cap(spark, d):
    c = clu(spark, d).select(F.pow(F.col("rate") - F.col("score"), 2).alias("e"))
    return rounded(c.agg(F.percentile("e", 0.95).alias("cap")))


_NAMES = """mcp_margin_entropy confusion_matrix class_metrics accuracy_macro_weighted micro_metrics cluster_error_rates class_report
failure_rate_distribution weighted_failure spearman spearman_p_value power_law_fit binned_trend risk_coverage macro_recall_curve
curve_interp_auc selective_metrics selective_recall rejection_curve avg_rank_combo atc_combo fold_percentile_rank quantile_bins atc_threshold
atc_cluster_risk error_mass_classes instance_calibration top_failing_clusters class_order_by_failure squared_error_cap""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_RISK = """rk AS (SELECT id, y, p, cluster, 1 - list_max(proba) AS mcp_risk, 1 - (list_reverse_sort(proba)[1] - list_reverse_sort(proba)[2]) AS margin_risk,
    -list_sum(list_transform(proba, lambda v: least(greatest(v, 1e-12), 1) * ln(least(greatest(v, 1e-12), 1)))) AS entropy_risk FROM pred)"""
_CM = """lab AS (SELECT y AS class FROM pred UNION SELECT p FROM pred),
  cm AS (SELECT class, (SELECT count(*) FROM pred WHERE y = class) AS support, (SELECT count(*) FROM pred WHERE y = class AND p = class) AS hit,
           (SELECT count(*) FROM pred WHERE p = class) AS said FROM lab),
  pr AS (SELECT class, support, hit, said, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM cm),
  fm AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""
_RC = """rc AS (SELECT row_number() OVER w AS pos, sum(support) OVER w / sum(support) OVER () AS coverage,
    sum((1 - rate) * support) OVER w / sum(support) OVER w AS accuracy FROM clu
    WINDOW w AS (ORDER BY {score}, ordinal ROWS UNBOUNDED PRECEDING))"""


def _interp(curve: str, value: str, name: str) -> str:
    return f"""{name}_s AS (SELECT pos, coverage AS x0, {value} AS y0, lead(coverage) OVER (ORDER BY pos) AS x1, lead({value}) OVER (ORDER BY pos) AS y1 FROM {curve}),
  {name}_g AS (SELECT g / 100.0 AS g, false AS t FROM range(0, 101) AS r(g) UNION ALL SELECT 0.8, true),
  {name}_a AS (SELECT g, t, CASE WHEN g <= x0 OR x1 IS NULL THEN y0 ELSE y0 + (g - x0) / (x1 - x0) * (y1 - y0) END AS y FROM {name}_g JOIN {name}_s
     ON (pos = 1 AND g <= x0) OR (g > x0 AND (g <= x1 OR x1 IS NULL))),
  {name} AS (SELECT (SELECT sum((y + b) / 2 * 0.01) FROM (SELECT y, lag(y) OVER (ORDER BY g) AS b FROM {name}_a WHERE NOT t)) AS aurc,
     (SELECT max(y) FROM {name}_a WHERE t) AS at_target)"""


def _mr(score: str, name: str) -> str:
    return f"""{name}_q AS (SELECT row_number() OVER (ORDER BY {score}, ordinal) AS pos, * FROM clu),
  {name} AS (SELECT a.pos, any_value(a.cov) AS coverage, avg(r) AS macro_recall FROM
     (SELECT pos, sum(support) OVER (ORDER BY pos) / sum(support) OVER () AS cov FROM {name}_q) a
     JOIN (SELECT x.pos, y.class, sum((1 - y.rate) * y.support) / sum(y.support) AS r FROM {name}_q x JOIN {name}_q y ON y.pos <= x.pos GROUP BY x.pos, y.class) b ON a.pos = b.pos GROUP BY a.pos)"""


_COMPARED = """{base} AS global_{what}, {pa} AS aurc_predictor, {oa} AS aurc_oracle, {pt} AS at_target_predictor, {ot} AS at_target_oracle,
  {lift} AS lift_over_random, {ben} AS oracle_benefit_recovered"""


def _compared(base: str, what: str) -> str:
    b = f"({base})"
    return _COMPARED.format(
        what=what, base=r6(b), pa=r6("p.aurc"), oa=r6("o.aurc"), pt=r6("p.at_target"), ot=r6("o.at_target"), lift=r6(f"p.at_target - {b}"),
        ben=r6(f"CASE WHEN o.at_target - {b} > 1e-9 THEN (p.at_target - {b}) / (o.at_target - {b}) END"),
    )


def _avg_rank(c: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}{c}"
    return f"(rank() OVER ({part}ORDER BY {c}) + (count(*) OVER ({same}) - 1) / 2)"


_REGION = f"{PRED}, {_RISK}, reg AS (SELECT id, y, p, rk.cluster, clu.rate AS region, round(mcp_risk, 9) AS mcp FROM rk JOIN clu ON clu.cluster = rk.cluster)"
_ATC = f"""{_REGION}, sq AS (SELECT 1 - mcp AS conf, row_number() OVER w AS pos, sum(CAST(y <> p AS BIGINT)) OVER () AS wr,
     sum(CAST(y = p AS BIGINT)) OVER w AS fn, sum(CAST(y <> p AS BIGINT)) OVER w AS gone FROM reg WINDOW w AS (ORDER BY 1 - mcp, id ROWS UNBOUNDED PRECEDING)),
  gp AS (SELECT conf, pos, abs(wr - gone - fn) AS gap FROM sq UNION ALL SELECT conf, 0, wr FROM sq WHERE pos = 1),
  th AS (SELECT conf AS threshold FROM gp ORDER BY gap, pos LIMIT 1),
  atc AS (SELECT cluster, avg(CAST(1 - mcp < threshold AS DOUBLE)) AS atc_risk FROM reg, th GROUP BY cluster)"""

ORACLE = {
    "mcp_margin_entropy": f"WITH {PRED}, {_RISK} SELECT id, y, p, {r6('mcp_risk')} AS mcp_risk, {r6('margin_risk')} AS margin_risk, {r6('entropy_risk')} AS entropy_risk FROM rk",
    "confusion_matrix": f"WITH {PRED} SELECT y, p, count(*) AS n, {r6('count(*) / sum(count(*)) OVER (PARTITION BY y)')} AS share FROM pred GROUP BY y, p",
    "class_metrics": f"WITH {PRED}, {_CM} SELECT class, support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM fm",
    "accuracy_macro_weighted": f"WITH {PRED}, {_CM} SELECT {r6('sum(hit) / sum(support)')} AS accuracy, "
    + ", ".join(f"{r6(f'avg({m})')} AS {m}_macro, {r6(f'sum({m} * support) / sum(support)')} AS {m}_weighted" for m in ("precision", "recall", "f1"))
    + " FROM fm",
    "micro_metrics": f"""WITH {PRED}, {_CM}, s AS (SELECT sum(hit) / (sum(said) + 1e-10) AS a, sum(hit) / (sum(support) + 1e-10) AS b, avg(f1) FILTER (support > 0) AS f FROM fm)
        SELECT {r6("a")} AS precision_micro, {r6("b")} AS recall_micro, {r6("2 * a * b / (a + b + 1e-10)")} AS f1_micro, {r6("f")} AS f1_macro_present FROM s""",
    "cluster_error_rates": f"""WITH {PRED}, {_RISK} SELECT cluster, CAST(sum(CAST(y <> p AS INTEGER)) AS BIGINT) AS n_error, count(*) AS n_total,
        {r6("avg(CAST(y <> p AS DOUBLE))")} AS failure_rate, {r6("avg(mcp_risk)")} AS mcp_risk, {r6("avg(entropy_risk)")} AS entropy_risk FROM rk GROUP BY cluster""",
    "class_report": f"""WITH {PRED}, {_RISK}, fn AS (SELECT y, string_agg(p || ':' || cs, ';' ORDER BY CAST(p AS VARCHAR)) AS f FROM
          (SELECT y, p, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS cs FROM (SELECT DISTINCT y, p, cluster FROM pred WHERE y <> p) GROUP BY y, p) GROUP BY y),
        tp AS (SELECT y, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS t FROM (SELECT DISTINCT y, cluster FROM pred WHERE y = p) GROUP BY y)
        SELECT rk.y AS class, count(*) AS n_total, count(*) FILTER (rk.y <> p) AS n_failed, {r6("avg(CAST(rk.y <> p AS DOUBLE))")} AS failure_rate,
          {r6("avg(1 - mcp_risk)")} AS mean_confidence, coalesce(any_value(t), '') AS clusters_tp, coalesce(any_value(f), '') AS clusters_fn
        FROM rk LEFT JOIN fn ON fn.y = rk.y LEFT JOIN tp ON tp.y = rk.y GROUP BY rk.y""",
    "failure_rate_distribution": f"WITH {PRED} SELECT {r6('min(rate)')} AS min, "
    + ", ".join(f"{r6(f'quantile_cont(rate, {q})')} AS {n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90")))
    + f", {r6('max(rate)')} AS max, {r6('avg(rate)')} AS mean, {r6('avg(CAST(rate = 0 AS DOUBLE))')} AS pct_zero FROM clu",
    "weighted_failure": f"""WITH {PRED} SELECT {r6("sum(rate * support) / sum(support)")} AS global_error,
        {r6("sum(CASE WHEN cluster % 10 = 3 THEN support ELSE 0 END) / sum(support)")} AS noise_share, count(*) FILTER (support = 0) AS n_untested,
        count(*) FILTER (cluster % 10 = 3) AS n_noise, count(*) AS n_clusters, count(*) FILTER (rate > 0) AS n_failing FROM clu""",
    "spearman": f"""WITH {PRED}, r AS (SELECT rate, score, {_avg_rank("rate")} AS a, {_avg_rank("score")} AS b, avg(rate) OVER () AS m FROM clu)
        SELECT count(*) AS n, {r6("corr(a, b)")} AS spearman, {r6("1 - sum(pow(rate - score, 2)) / sum(pow(rate - m, 2))")} AS r2, {r6("avg(abs(rate - score))")} AS mae FROM r""",
    "power_law_fit": f"""WITH t AS (SELECT CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS m, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1)
        SELECT {r6("regr_slope(ln(t), ln(m))")} AS alpha, {r6("exp(regr_intercept(ln(t), ln(m)))")} AS c, {r6("regr_r2(ln(t), ln(m))")} AS r2, count(*) AS n_points FROM t""",
    "binned_trend": """WITH s AS (SELECT ln(l_extendedprice) AS x, l_quantity AS y, min(ln(l_extendedprice)) OVER () AS lo, max(ln(l_extendedprice)) OVER () AS hi FROM lineitem WHERE l_extendedprice > 0)
        SELECT CAST(least(7, floor((x - lo) / ((hi - lo) / 8))) AS INTEGER) AS bin, count(*) AS n, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS std FROM s GROUP BY 1""",
    "risk_coverage": f"WITH {PRED}, {_RC.format(score='score')} SELECT CAST(pos AS INTEGER) AS pos, {r6('coverage')} AS coverage, {r6('accuracy')} AS accuracy FROM rc",
    "rejection_curve": f"WITH {PRED}, {_RC.format(score='score')} SELECT CAST(pos AS INTEGER) AS pos, {r6('1 - coverage')} AS rejected, {r6('1 - accuracy')} AS error FROM rc",
    "macro_recall_curve": f"WITH {PRED}, {_mr('score', 'm')} SELECT CAST(pos AS INTEGER) AS pos, {r6('coverage')} AS coverage, {r6('macro_recall')} AS macro_recall FROM m",
    "curve_interp_auc": f"WITH {PRED}, {_RC.format(score='score')}, {_interp('rc', 'accuracy', 'p')} SELECT {r6('aurc')} AS aurc, {r6('at_target')} AS at_target FROM p",
    "selective_metrics": f"""WITH {PRED}, {_RC.format(score="score")}, {_RC.format(score="rate").replace("rc AS", "ro AS", 1)}, {_interp("rc", "accuracy", "p")}, {_interp("ro", "accuracy", "o")}
        SELECT {_compared("SELECT 1 - sum(rate * support) / sum(support) FROM clu", "accuracy")} FROM p, o""",
    "selective_recall": f"""WITH {PRED}, {_mr("score", "m")}, {_mr("rate", "n")}, {_interp("m", "macro_recall", "p")}, {_interp("n", "macro_recall", "o")}
        SELECT {_compared("SELECT avg(r) FROM (SELECT sum((1 - rate) * support) / sum(support) AS r FROM clu GROUP BY class)", "recall")} FROM p, o""",
    "avg_rank_combo": f"""WITH {_REGION} SELECT id, {r6("avg(mcp) OVER (PARTITION BY cluster)")} AS mcp_cluster,
        {r6(f"{_avg_rank('region')} / (count(*) OVER () + 1) + {_avg_rank('mcp')} / (count(*) OVER () + 1)")} AS combo_rankavg,
        {r6(f"dense_rank() OVER (ORDER BY region) - 1 + {_avg_rank('mcp')} / (count(*) OVER () + 1)")} AS combo_within FROM reg""",
    "fold_percentile_rank": f"""WITH {_REGION}, f AS (SELECT *, id % 5 AS fold FROM reg)
        SELECT id, fold, {r6(f"CASE WHEN count(*) OVER (PARTITION BY fold) > 1 THEN ({_avg_rank('mcp', 'fold')} - 1) / (count(*) OVER (PARTITION BY fold) - 1) ELSE 0.5 END")} AS fold_rank FROM f""",
    "quantile_bins": """WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
        SELECT o_orderkey, o_totalprice, CAST(len(list_filter(q, lambda e: o_totalprice > e)) AS INTEGER) AS bin FROM orders, q""",
    "atc_combo": f"""WITH {_ATC}, j AS (SELECT id, region, atc_risk FROM reg JOIN atc USING (cluster)),
        k AS (SELECT *, rank() OVER (ORDER BY region) + (count(*) OVER (PARTITION BY region) - 1) / 2 AS rr,
                rank() OVER (ORDER BY atc_risk) + (count(*) OVER (PARTITION BY atc_risk) - 1) / 2 AS ra, count(*) OVER () AS n FROM j)
        SELECT id, {r6("atc_risk")} AS atc_cluster, {r6("rr / (n + 1) + ra / (n + 1)")} AS combo_atc_rankavg FROM k""",
    "atc_threshold": f"WITH {_ATC} SELECT {r6('threshold')} AS threshold FROM th",
    "atc_cluster_risk": f"WITH {_ATC} SELECT cluster, {r6('atc_risk')} AS atc_risk FROM atc",
    "error_mass_classes": f"""WITH {PRED}, e AS (SELECT y AS class, count(*) FILTER (y <> p) AS errors FROM pred GROUP BY y),
        r AS (SELECT class, errors, row_number() OVER (ORDER BY errors DESC, class) AS rank, sum(errors) OVER (ORDER BY errors DESC, class ROWS UNBOUNDED PRECEDING) - errors AS b, sum(errors) OVER () AS t FROM e)
        SELECT class, errors, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2 OR b < t * 0.9""",
    "instance_calibration": f"""WITH {_ATC}, w AS (SELECT reg.*, CAST(y <> p AS DOUBLE) AS wrong, atc_risk FROM reg JOIN atc ON atc.cluster = reg.cluster)
        SELECT {r6("avg(pow(region - wrong, 2))")} AS mse_region, {r6("avg(pow(mcp - wrong, 2))")} AS mse_mcp, {r6("abs(avg(atc_risk) - avg(wrong))")} AS atc_abs_error FROM w""",
    "top_failing_clusters": f"WITH {PRED} SELECT cluster, class, support, {r6('rate')} AS rate FROM clu ORDER BY clu.rate DESC, cluster LIMIT 10",
    "class_order_by_failure": f"""WITH {PRED}, c AS (SELECT class, median(rate) AS m, count(*) AS n_clusters, count(*) FILTER (rate > 0) AS n_failing FROM clu GROUP BY class)
        SELECT class, {r6("m")} AS median_rate, n_clusters, n_failing, CAST(row_number() OVER (ORDER BY m DESC, class) AS INTEGER) AS pos FROM c""",
    "squared_error_cap": f"WITH {PRED} SELECT {r6('quantile_cont(pow(rate - score, 2), 0.95)')} AS cap FROM clu",
}
