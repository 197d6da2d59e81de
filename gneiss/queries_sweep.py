"""Queries on run summaries. A run is read off orders: status is the configuration, priority the classifier, segment the data set."""

from __future__ import annotations

from pyspark.sql import functions as F

from gneiss.operators import sweep
from gneiss.plans.scratch import table
from gneiss.plans.views import r6, rounded


def _runs(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    m = F.col("o_orderkey") % 1000
    return j.select(
        F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("classifier"), F.col("c_mktsegment").alias("dataset"),
        ((m - 200) / 800).alias("rho"), F.when(m % 50 == 0, float("nan")).otherwise((m - 500) / 1000).alias("lift"), ((m - 600) / 1000).alias("low"), ((m - 400) / 1000).alias("high"),
        (m % 40).alias("n_clusters"), F.when(F.col("o_orderkey") % 2 == 0, "cosine").otherwise("euclidean").alias("distance"),
    )


def _timings(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("run"), F.when(F.col("l_linenumber") <= 3, "build_knn_graph").otherwise("fit").alias("function"), (F.col("l_quantity") / 10).alias("duration_s"))


def _importances(spark, d):
    names = ["cluster_f1_mean", "class_f3_min", "cluster_n2_max", "cluster_network_density_mean", "class_t3", "cluster_p95_dispersion", "support"]
    name = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names)).cast("int"))
    return table(spark, d, "orders").select(name.alias("name"), (F.col("o_orderkey") % 100 / 100.0).alias("value"))


def config_table(spark, d):
    return rounded(sweep.config_table(_runs(spark, d), ["variant", "distance"], "rho"))


def cluster_count_table(spark, d):
    return sweep.cluster_count_table(_runs(spark, d), ["variant"], "n_clusters")


def grouping_sets_table(spark, d):
    return rounded(sweep.classifier_and_dataset_table(_runs(spark, d), "rho"))


def lift_table(spark, d):
    return rounded(sweep.lift_table(_runs(spark, d), ["classifier"], "lift", "low", "high"))


def family_importance(spark, d):
    return rounded(sweep.family_importance(_importances(spark, d)))


def mean_importance(spark, d):
    return rounded(sweep.mean_importance(_importances(spark, d), 3))


def instance_table(spark, d):
    r = _runs(spark, d).select(F.floor(F.col("run") / 5).alias("run"), F.col("classifier").alias("method"), F.col("variant").alias("dataset"), F.col("rho").alias("value"))
    return rounded(sweep.instance_table(r.groupBy("run", "method").agg(F.avg("value").alias("value"), F.min("dataset").alias("dataset")), "1-URGENT"))


def cost_quality(spark, d):
    r = _runs(spark, d).withColumnRenamed("variant", "algorithm")
    return rounded(sweep.cost_quality(r, _timings(spark, d), "rho"))


def stage_seconds(spark, d):
    return rounded(sweep.stage_seconds(_timings(spark, d), ["build_knn_graph"]))


def cost_model_summary(spark, d):
    m = _runs(spark, d).groupBy("distance", "dataset").agg(F.avg("rho").alias("alpha"), F.max("rho").alias("c"), F.min("rho").alias("r2"))
    return rounded(sweep.cost_model_summary(m))


def cost_units(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).alias("m"), F.lit(29).alias("d"), F.lit(30).alias("k"))
    return sweep.cost_units(p).select("p_partkey", "pairs", "pair_features", "edges")


def scoreboard(spark, d):
    return rounded(sweep.scoreboard(_runs(spark, d).withColumn("lift", F.nanvl("lift", F.lit(None))), "rho", "lift"))


def histogram(spark, d):
    return sweep.histogram(_runs(spark, d), "rho", -0.25, 1.0)


def pivot_table(spark, d):
    return rounded(sweep.pivot_table(_runs(spark, d), "dataset", "variant", ["F", "O", "P"], "rho"))


def base_vs_extended(spark, d):
    a = _runs(spark, d).groupBy(F.col("dataset").alias("key"), "variant").agg(F.avg("rho").alias("r"), F.avg("high").alias("h"))
    pack = a.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("variant", "r", "h"))).alias("z"))
    return rounded(sweep.base_vs_extended(pack.select("key", F.transform("z", lambda s: s["r"]).alias("f1")), pack.select("key", F.transform("z", lambda s: s["h"]).alias("f1"))))


def select_runs(spark, d):
    return sweep.select_runs(_runs(spark, d), variant=["F", "P"], distance="cosine", dataset=None).select("run", "variant", "classifier")


_NAMES = """config_table cluster_count_table grouping_sets_table lift_table family_importance mean_importance instance_table cost_quality
stage_seconds cost_model_summary cost_units scoreboard histogram pivot_table base_vs_extended select_runs""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_R = """r AS (SELECT o_orderkey AS run, o_orderstatus AS variant, o_orderpriority AS classifier, c_mktsegment AS dataset, (o_orderkey % 1000 - 200) / 800 AS rho,
    CASE WHEN o_orderkey % 1000 % 50 = 0 THEN NULL ELSE (o_orderkey % 1000 - 500) / 1000 END AS lift, (o_orderkey % 1000 - 600) / 1000 AS low, (o_orderkey % 1000 - 400) / 1000 AS high,
    o_orderkey % 1000 % 40 AS n_clusters, CASE WHEN o_orderkey % 2 = 0 THEN 'cosine' ELSE 'euclidean' END AS distance FROM orders JOIN customer ON o_custkey = c_custkey)"""
_T = "t AS (SELECT l_orderkey AS run, CASE WHEN l_linenumber <= 3 THEN 'build_knn_graph' ELSE 'fit' END AS function, l_quantity / 10 AS duration_s FROM lineitem)"
_I = """i AS (SELECT ['cluster_f1_mean', 'class_f3_min', 'cluster_n2_max', 'cluster_network_density_mean', 'class_t3', 'cluster_p95_dispersion', 'support'][o_orderkey % 7 + 1] AS name,
    o_orderkey % 100 / 100.0 AS value FROM orders)"""
ORACLE = {
    "config_table": f"""WITH {_R} SELECT variant, distance, {r6("avg(rho)")} AS mean, {r6("median(rho)")} AS median, {r6("coalesce(stddev_samp(rho), 0)")} AS std,
        {r6("avg(CAST(rho > 0.7 AS DOUBLE))")} AS above, {r6("avg(CAST(rho < 0 AS DOUBLE))")} AS below, count(*) AS n FROM r GROUP BY variant, distance""",
    "cluster_count_table": f"WITH {_R} SELECT variant, median(n_clusters) AS median, min(n_clusters) AS min, max(n_clusters) AS max, count(*) AS n FROM r GROUP BY variant",
    "grouping_sets_table": f"""WITH {_R} SELECT CASE WHEN grouping(classifier) = 0 THEN 'classifier' ELSE 'dataset' END AS axis, coalesce(classifier, dataset) AS name,
        {r6("avg(rho)")} AS mean, count(rho) AS n FROM r GROUP BY GROUPING SETS ((classifier), (dataset))""",
    "lift_table": f"""WITH {_R} SELECT classifier, {r6("avg(lift)")} AS mean_lift, {r6("median(lift)")} AS median_lift, {r6("avg(CAST(low > 0 AS DOUBLE))")} AS better,
        {r6("avg(CAST(high < 0 AS DOUBLE))")} AS worse, count(lift) AS n, {r6("avg(CAST(low > 0 AS DOUBLE)) - avg(CAST(high < 0 AS DOUBLE))")} AS net FROM r GROUP BY classifier""",
    "family_importance": f"""WITH {_I}, f AS (SELECT CASE name WHEN 'cluster_f1_mean' THEN 'feature-overlap' WHEN 'class_f3_min' THEN 'feature-overlap' WHEN 'cluster_n2_max' THEN 'neighbourhood'
          WHEN 'cluster_network_density_mean' THEN 'network' WHEN 'class_t3' THEN 'dimensionality' WHEN 'cluster_p95_dispersion' THEN 'cluster-geometry' ELSE 'other' END AS family,
          CASE WHEN name LIKE 'class\\_%' ESCAPE '\\' THEN 'class' ELSE 'cluster' END AS level, value FROM i)
        SELECT family, level, {r6("100 * sum(value) / (SELECT sum(value) FROM i)")} AS percent FROM f GROUP BY family, level""",
    "mean_importance": f"WITH {_I} SELECT name, {r6('avg(abs(value))')} AS mean_abs FROM i GROUP BY name ORDER BY avg(abs(value)) DESC, name LIMIT 3",
    "instance_table": f"""WITH {_R}, m AS (SELECT CAST(floor(run / 5) AS BIGINT) AS run, classifier AS method, avg(rho) AS value, min(variant) AS dataset FROM r GROUP BY 1, 2),
        b AS (SELECT m.*, k.value AS r0 FROM m LEFT JOIN m k ON k.run = m.run AND k.method = '1-URGENT'),
        p AS (SELECT method, avg(d) AS mean_delta FROM (SELECT method, dataset, avg(value - r0) AS d FROM b GROUP BY ALL) GROUP BY method)
        SELECT method, {r6("median(value)")} AS median, {r6("any_value(mean_delta)")} AS mean_delta FROM b JOIN p USING (method) GROUP BY method""",
    "cost_quality": f"""WITH {_R}, {_T}, s AS (SELECT run, sum(duration_s) AS s FROM t WHERE function = 'build_knn_graph' GROUP BY run)
        SELECT variant AS algorithm, distance, dataset, {r6("avg(rho)")} AS quality, {r6("coalesce(stddev_samp(rho), 0)")} AS std, {r6("avg(s)")} AS build_s, count(*) AS n
        FROM r JOIN s USING (run) GROUP BY variant, distance, dataset""",
    "stage_seconds": f"""WITH {_T} SELECT run, {r6("coalesce(sum(duration_s) FILTER (function = 'build_knn_graph'), 0)")} AS inside_s,
        {r6("coalesce(sum(duration_s) FILTER (function <> 'build_knn_graph'), 0)")} AS other_s FROM t GROUP BY run""",
    "cost_model_summary": f"""WITH {_R}, m AS (SELECT distance, dataset, avg(rho) AS alpha, max(rho) AS c, min(rho) AS r2 FROM r GROUP BY ALL),
        p AS (SELECT distance, avg(alpha) AS alpha, coalesce(stddev_samp(alpha), 0) AS alpha_std, avg(c) AS c, min(r2) AS r2_min, count(*) AS n FROM m GROUP BY distance)
        SELECT distance, {r6("alpha")} AS alpha, {r6("alpha_std")} AS alpha_std, {r6("c")} AS c, {r6("r2_min")} AS r2_min, n,
          {r6("c / (SELECT c FROM p WHERE distance = 'cosine')")} AS c_ratio FROM p""",
    "cost_units": """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS m FROM part)
        SELECT p_partkey, m * (m - 1) AS pairs, m * (m - 1) * 29 AS pair_features, m * 30 AS edges FROM p""",
    "scoreboard": f"WITH {_R} SELECT {r6('avg(rho)')} AS mean_rho, {r6('avg(CAST(rho >= 0.6 AS DOUBLE))')} AS share_strong, {r6('avg(lift)')} AS mean_lift, count(*) AS n FROM r",
    "histogram": f"WITH {_R} SELECT CAST(least(20, floor((rho + 0.25) / (1.25 / 20)) + 1) AS INTEGER) AS bin, count(*) AS n FROM r GROUP BY 1",
    "pivot_table": f"""WITH {_R}, p AS (SELECT dataset, avg(rho) FILTER (variant = 'F') AS "F", avg(rho) FILTER (variant = 'O') AS "O", avg(rho) FILTER (variant = 'P') AS "P" FROM r GROUP BY dataset)
        SELECT dataset, {r6('"F"')} AS "F", {r6('"O"')} AS "O", {r6('"P"')} AS "P", CAST("F" IS NULL AS INTEGER) + CAST("O" IS NULL AS INTEGER) + CAST("P" IS NULL AS INTEGER) AS n_empty FROM p""",
    "base_vs_extended": f"""WITH {_R}, a AS (SELECT dataset AS key, variant, avg(rho) AS r, avg(high) AS h FROM r GROUP BY ALL)
        SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY variant) - 1 AS INTEGER) AS pos, {r6("h - r")} AS delta FROM a""",
    "select_runs": f"WITH {_R} SELECT run, variant, classifier FROM r WHERE variant IN ('F', 'P') AND distance = 'cosine'",
}
