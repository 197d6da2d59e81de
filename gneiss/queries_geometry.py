"""Queries on centroids, neighbours and complexity measures of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import complexity, geometry, joins, metrics
from gneiss.operators.encode import l2_normalise
from gneiss.plans.scratch import materialize
from gneiss.plans.views import EMB, PRED, emb, pred, r6, rounded, sql_means

K = 10
TOP = 3


def _cents(spark: SparkSession, d: str) -> DataFrame:
    points = emb(spark, d)
    classes = points.groupBy("cluster").agg(F.any_value("class").alias("class"))
    return geometry.centroids(points, "cluster").join(classes, "cluster")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return geometry.adversaries(_cents(spark, d), TOP)


def _members(spark: SparkSession, d: str) -> DataFrame:
    return emb(spark, d).select("id", "cluster")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return materialize(geometry.knn_graph(emb(spark, d), K))


def class_centroids(spark, d):
    return rounded(geometry.centroids(emb(spark, d), "class").select("class", F.posexplode("centroid").alias("f", "v")))


def spherical_centroids(spark, d):
    return rounded(geometry.centroids(emb(spark, d), "class", spherical=True).select("class", F.posexplode("centroid").alias("f", "v")))


def nearest_centroid(spark, d):
    out = geometry.nearest_centroid(emb(spark, d), _cents(spark, d), "cluster")
    return rounded(out.select("id", "assigned", "dist"))


def nearest_centroid_cosine(spark, d):
    out = geometry.nearest_centroid(emb(spark, d), _cents(spark, d), "cluster", metric="cosine")
    return rounded(out.select("id", "assigned", "dist"))


def nearest_centroid_within_class(spark, d):
    cents = _cents(spark, d).filter("class <> 3")
    out = geometry.nearest_centroid(emb(spark, d), cents, "cluster", within_class=True)
    return rounded(out.select("id", "assigned", "dist"))


def adversary_topk(spark, d):
    return rounded(_pairs(spark, d))


def knn_cosine(spark, d):
    return rounded(geometry.knn_graph(emb(spark, d), K))


def knn_gower_euclidean(spark, d):
    return rounded(geometry.knn_graph(emb(spark, d), K, metric="euclidean"))


def knn_mixed(spark, d):
    cats = F.array((F.col("id") % 3).cast("int"), (F.col("class") % 2).cast("int"))
    return rounded(geometry.knn_graph(emb(spark, d).withColumn("cats", cats), K, n_cats=2))


def nn_label_propagation(spark, d):
    """1-NN propagation of the labels of a fitted sample (ids divisible by 5) to all points."""
    points = emb(spark, d)
    sample = points.filter("id % 5 = 0").select(F.col("id").alias("cluster"), F.col("x").alias("centroid"), "class")
    near = geometry.nearest_centroid(points.select("id", "x"), sample, "cluster")
    labels = sample.select(F.col("cluster").alias("assigned"), F.col("class").alias("label"))
    return near.join(labels, "assigned").select("id", "assigned", "label")


def fisher_f1(spark, d):
    p = complexity.fisher_and_volume(_pairs(spark, d), complexity.feature_stats(emb(spark, d)))
    return rounded(p.select("c", "j", "f1"))


def overlap_f2(spark, d):
    p = complexity.fisher_and_volume(_pairs(spark, d), complexity.feature_stats(emb(spark, d)))
    return rounded(p.select("c", "j", "f2"))


def overlap_f3_f4(spark, d):
    points = emb(spark, d)
    return rounded(complexity.overlap_shares(points, _pairs(spark, d), complexity.feature_stats(points)))


def neighbourhood_n2_n3_n4(spark, d):
    votes = complexity.neighbour_votes(_edges(spark, d), _members(spark, d), _pairs(spark, d))
    return rounded(complexity.neighbourhood(votes, K))


def clustering_coef(spark, d):
    return rounded(complexity.clustering_coefficient(_edges(spark, d), _members(spark, d)))


def hubness(spark, d):
    return rounded(complexity.hubness(_edges(spark, d), _members(spark, d)))


def t2_ratio(spark, d):
    return rounded(complexity.density_ratio(_members(spark, d), 64, 0))


def pca_t3_t4(spark, d):
    return rounded(complexity.pca_ratios(emb(spark, d)))


def mst_n1(spark, d):
    members = _members(spark, d)
    tree = complexity.spanning_tree(_edges(spark, d), emb(spark, d))
    return rounded(complexity.borderline(tree, members, _pairs(spark, d)))


def cluster_dispersion(spark, d):
    return rounded(complexity.dispersion(emb(spark, d), _cents(spark, d)))


def nearest_centroid_gap(spark, d):
    return rounded(complexity.centroid_gap(_cents(spark, d)))


def silhouette(spark, d):
    return rounded(complexity.silhouette(emb(spark, d)))


def silhouette_risk(spark, d):
    return rounded(complexity.silhouette_measures(complexity.silhouette(emb(spark, d))))


def complexity_table(spark: SparkSession, d: str, level: str = "cluster", metric: str = "euclidean") -> DataFrame:
    """All measures of every cluster (or class), one row each; the k-NN graph is built once. Clusters below five rows are noise.

    ``metric`` is that of centroids' and silhouette distances; with cosine, feature overlaps are those of the normalised points.
    """
    every = emb(spark, d).withColumn("cluster", F.col(level))
    small = every.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n < 5")
    noise = materialize(small.select(F.col("cluster").cast("bigint").alias("cluster")))
    points = materialize(every.join(F.broadcast(noise), "cluster", "left_anti"))
    shape = points.withColumn("x", l2_normalise(F.col("x"))) if metric == "cosine" else points
    members = points.select("id", "cluster")
    edges = materialize(geometry.knn_graph(points, K))
    classes = points.groupBy("cluster").agg(F.any_value("class").alias("class"))
    cents = materialize(geometry.centroids(points, "cluster", spherical=metric == "cosine").join(classes, "cluster"))
    pairs = materialize(geometry.adversaries(cents, TOP, metric=metric))
    stats = materialize(complexity.feature_stats(shape))
    tree = complexity.spanning_tree(edges, points)
    both = (
        complexity.fisher_and_volume(pairs, stats)
        .join(complexity.overlap_shares(shape, pairs, stats), ["c", "j"], "full")
        .join(complexity.neighbourhood(complexity.neighbour_votes(edges, members, pairs), K), ["c", "j"], "full")
        .join(complexity.borderline(tree, members, pairs), ["c", "j"], "full")
    )
    names = ["f1", "f2", "f3", "f4", "n1", "n2", "n3", "n4", "network_density"]
    out = complexity.min_mean_max(both, classes, names)
    for more in (
        complexity.clustering_coefficient(edges, members),
        complexity.hubness(edges, members),
        complexity.density_ratio(members, 64, 0),
        complexity.pca_ratios(points),
        complexity.dispersion(points, cents, metric=metric),
        complexity.centroid_gap(cents, metric=metric),
        complexity.silhouette_measures(complexity.silhouette(points, metric=metric)),
        classes.withColumnRenamed("class", "cluster_class"),
    ):
        out = out.join(more, "cluster", "left")
    return rounded(complexity.with_noise_rows(out, noise))


def complexity_table_cosine(spark, d):
    return complexity_table(spark, d, metric="cosine")


def cosine_dispersion(spark, d):
    return rounded(complexity.dispersion(emb(spark, d), _cents(spark, d), metric="cosine"))


def cosine_centroid_gap(spark, d):
    return rounded(complexity.centroid_gap(_cents(spark, d), metric="cosine"))


def class_complexity_table(spark, d):
    return complexity_table(spark, d, "class")


def cluster_summary_join(spark, d):
    points, p = emb(spark, d), pred(spark, d)
    own = complexity.hubness(_edges(spark, d), _members(spark, d)).join(points.groupBy("cluster").agg(F.any_value("class").alias("cluster_class")), "cluster")
    up = complexity.density_ratio(points.select("id", F.col("class").alias("cluster")), 64, 0).withColumnRenamed("cluster", "class")
    errors = metrics.cluster_errors(p.filter("id % 3 = 0"))
    return rounded(joins.cluster_summary(own, up, errors))


_NAMES = """class_centroids spherical_centroids nearest_centroid nearest_centroid_cosine nearest_centroid_within_class
adversary_topk knn_cosine knn_gower_euclidean knn_mixed nn_label_propagation fisher_f1 overlap_f2 overlap_f3_f4
neighbourhood_n2_n3_n4 clustering_coef hubness t2_ratio pca_t3_t4 mst_n1 cluster_dispersion nearest_centroid_gap complexity_table_cosine cosine_dispersion cosine_centroid_gap silhouette
silhouette_risk complexity_table class_complexity_table cluster_summary_join""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_CENT = f"{EMB}, {sql_means('cm', 'cluster')}, cent AS (SELECT cm.cluster, centroid, class FROM cm JOIN (SELECT DISTINCT cluster, class FROM emb) USING (cluster))"
_ADV = f"""{_CENT}, adv AS (SELECT a.cluster AS c, b.cluster AS j, list_distance(a.centroid, b.centroid) AS dist,
    CAST(row_number() OVER (PARTITION BY a.cluster ORDER BY list_distance(a.centroid, b.centroid), b.cluster) AS INTEGER) AS rank
    FROM cent a JOIN cent b ON a.class <> b.class QUALIFY rank <= {TOP})"""
_STATS = """st AS (SELECT cluster, f, avg(x[f]) AS mu, var_pop(x[f]) AS v, min(x[f]) AS lo, max(x[f]) AS hi, count(*) AS n
    FROM emb, range(1, 65) AS r(f) GROUP BY cluster, f HAVING count(*) > 1),
  ps AS (SELECT adv.c, adv.j, a.f, a.mu AS mc, b.mu AS mj, a.v AS vc, b.v AS vj, a.lo AS lc, b.lo AS lj, a.hi AS hc, b.hi AS hj
    FROM adv JOIN st a ON a.cluster = adv.c JOIN st b ON b.cluster = adv.j AND b.f = a.f)"""


def _knn(expr: str, source: str = "emb") -> str:
    return f"""knn AS (SELECT a.id AS src, b.id AS dst, {expr} AS dist,
      CAST(row_number() OVER (PARTITION BY a.id ORDER BY round({expr}, 12), b.id) AS INTEGER) AS rank
      FROM {source} a JOIN {source} b ON a.id <> b.id QUALIFY rank <= {K})"""


_COS = "least(greatest(1 - list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 0), 1)"
_VOTES = """e AS (SELECT src, m.cluster AS k, count(*) AS v, min(dist) AS d, min(rank) AS r FROM knn JOIN emb m ON m.id = dst GROUP BY ALL),
  vt AS (SELECT adv.c, adv.j, s.id AS src, coalesce(a.v, 0) AS vc, coalesce(b.v, 0) AS vj, a.d AS dc, b.d AS dj,
      coalesce(b.r < coalesce(a.r, 999999), false) AS fj
    FROM adv JOIN emb s ON s.cluster = adv.c LEFT JOIN e a ON a.src = s.id AND a.k = adv.c LEFT JOIN e b ON b.src = s.id AND b.k = adv.j)"""
_SIL = """dm AS (SELECT a.id, a.cluster, b.cluster AS k, sum(list_distance(a.x, b.x)) AS t FROM emb a JOIN emb b ON true GROUP BY ALL),
  sz AS (SELECT cluster AS k, count(*) AS n FROM emb GROUP BY 1),
  ab AS (SELECT id, cluster, max(CASE WHEN k = cluster AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN k <> cluster THEN t / n END) AS b,
           max(CASE WHEN k = cluster THEN n END) AS n FROM dm JOIN sz USING (k) GROUP BY id, cluster),
  sil AS (SELECT id, cluster, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""
_INNER = """inn AS (SELECT src, dst, a.cluster FROM knn JOIN emb a ON a.id = src JOIN emb b ON b.id = dst AND b.cluster = a.cluster),
  tri AS (SELECT p.src, count(*) AS t FROM inn p JOIN inn q ON q.src = p.dst JOIN inn r ON r.src = p.src AND r.dst = q.dst GROUP BY 1),
  deg AS (SELECT src, count(*) AS z FROM inn GROUP BY 1)"""

ORACLE = {
    "class_centroids": f"WITH {EMB} SELECT class, CAST(f - 1 AS INTEGER) AS f, {r6('avg(x[f])')} AS v FROM emb, range(1, 65) AS r(f) GROUP BY class, f",
    "spherical_centroids": f"""WITH {EMB}, n AS (SELECT class, list_transform(x, lambda v: v / greatest(sqrt(list_dot_product(x, x)), 1e-8)) AS x FROM emb),
        m AS (SELECT class, f, avg(x[f]) AS m FROM n, range(1, 65) AS r(f) GROUP BY class, f)
        SELECT class, CAST(f - 1 AS INTEGER) AS f, {r6("m / greatest(sqrt(sum(m * m) OVER (PARTITION BY class)), 1e-8)")} AS v FROM m""",
    "nearest_centroid": f"""WITH {_CENT} SELECT id, arg_min(k.cluster, list_distance(x, centroid)) AS assigned, {r6("min(list_distance(x, centroid))")} AS dist
        FROM emb, cent k GROUP BY id""",
    "nearest_centroid_cosine": f"""WITH {_CENT}, c AS (SELECT id, k.cluster,
        1 - list_dot_product(x, centroid) / sqrt(list_dot_product(x, x) * list_dot_product(centroid, centroid)) AS d FROM emb, cent k)
        SELECT id, arg_min(cluster, d) AS assigned, {r6("min(d)")} AS dist FROM c GROUP BY id""",
    "nearest_centroid_within_class": f"""WITH {_CENT} SELECT id, coalesce(arg_min(k.cluster, list_distance(x, centroid)), -1) AS assigned,
        {r6("min(list_distance(x, centroid))")} AS dist FROM emb LEFT JOIN cent k ON k.class = emb.class AND k.class <> 3 GROUP BY id""",
    "adversary_topk": f"WITH {_ADV} SELECT c, j, {r6('dist')} AS dist, rank FROM adv",
    "knn_cosine": f"WITH {EMB}, {_knn(_COS)} SELECT src, dst, rank, {r6('dist')} AS dist FROM knn",
    "knn_gower_euclidean": f"""WITH {EMB}, sp AS (SELECT list(w ORDER BY f) AS w FROM (SELECT f, greatest(max(x[f]) - min(x[f]), 1e-8) AS w FROM emb, range(1, 65) AS r(f) GROUP BY f)),
        sc AS (SELECT id, list_transform(list_zip(x, w), lambda z: z[1] / z[2]) AS x FROM emb, sp),
        {_knn("list_sum(list_transform(list_zip(a.x, b.x), lambda z: abs(z[1] - z[2]))) / 64", "sc")}
        SELECT src, dst, rank, {r6("dist")} AS dist FROM knn""",
    "knn_mixed": f"""WITH {EMB}, {_knn(f"(64 * {_COS} + CAST(a.id % 3 <> b.id % 3 AS INTEGER) + CAST(a.class % 2 <> b.class % 2 AS INTEGER)) / 66")}
        SELECT src, dst, rank, {r6("dist")} AS dist FROM knn""",
    "nn_label_propagation": f"""WITH {EMB}, m AS (SELECT a.id, arg_min(b.id, list_distance(a.x, b.x)) AS assigned FROM emb a, emb b WHERE b.id % 5 = 0 GROUP BY a.id)
        SELECT m.id, assigned, class AS label FROM m JOIN emb ON emb.id = assigned""",
    "fisher_f1": f"WITH {_ADV}, {_STATS} SELECT c, j, {r6('1 / (1 + max(pow(mc - mj, 2) / (vc + vj + 1e-8)))')} AS f1 FROM ps GROUP BY c, j",
    "overlap_f2": f"""WITH {_ADV}, {_STATS} SELECT c, j,
        {r6("avg(greatest(0, least(hc, hj) - greatest(lc, lj)) / (greatest(hc, hj) - least(lc, lj) + 1e-8))")} AS f2 FROM ps GROUP BY c, j""",
    "overlap_f3_f4": f"""WITH {_ADV}, {_STATS}, i AS (SELECT c, j, f, id, x[f] BETWEEN greatest(lc, lj) AND least(hc, hj) AS inside FROM ps JOIN emb ON cluster = c),
        f3 AS (SELECT c, j, min(s) AS f3 FROM (SELECT c, j, f, avg(CAST(inside AS DOUBLE)) AS s FROM i GROUP BY ALL) GROUP BY c, j),
        f4 AS (SELECT c, j, avg(CAST(a AS DOUBLE)) AS f4 FROM (SELECT c, j, id, bool_and(inside) AS a FROM i GROUP BY ALL) GROUP BY c, j)
        SELECT c, j, {r6("f3")} AS f3, {r6("f4")} AS f4 FROM f3 JOIN f4 USING (c, j)""",
    "neighbourhood_n2_n3_n4": f"""WITH {_ADV}, {_knn(_COS)}, {_VOTES} SELECT c, j, {r6("coalesce(avg(dc / (dc + dj + 1e-8)), 0)")} AS n2,
        {r6("coalesce(count(*) FILTER (fj) / nullif(count(*) FILTER (vc + vj > 0), 0), 0)")} AS n3,
        {r6("coalesce(count(*) FILTER (vj > vc) / nullif(count(*) FILTER (vc + vj > 0), 0), 0)")} AS n4,
        {r6(f"sum(vj) / (count(*) * {K})")} AS network_density FROM vt GROUP BY c, j""",
    "clustering_coef": f"""WITH {EMB}, {_knn(_COS)}, {_INNER} SELECT cluster, {r6("avg(CASE WHEN z > 1 THEN coalesce(t, 0) / (z * (z - 1)) ELSE 0 END)")} AS cls_coef
        FROM emb LEFT JOIN deg ON deg.src = id LEFT JOIN tri ON tri.src = id GROUP BY cluster""",
    "hubness": f"""WITH {EMB}, {_knn(_COS)}, s AS (SELECT dst, count(*) AS n FROM knn GROUP BY 1)
        SELECT cluster, {r6("avg(coalesce(n, 0))")} AS hub FROM emb LEFT JOIN s ON dst = id GROUP BY cluster""",
    "t2_ratio": f"WITH {EMB} SELECT cluster, {r6('64.0 / count(*)')} AS t2 FROM emb GROUP BY cluster",
    "cluster_dispersion": f"""WITH {_CENT} SELECT cluster, {r6("max(list_distance(x, centroid))")} AS max_dispersion,
        {r6("quantile_cont(list_distance(x, centroid), 0.95)")} AS p95_dispersion FROM emb JOIN cent USING (cluster) GROUP BY cluster""",
    "nearest_centroid_gap": f"""WITH {_CENT} SELECT a.cluster, {r6("min(list_distance(a.centroid, b.centroid))")} AS dist_to_nearest_centroid
        FROM cent a JOIN cent b ON a.cluster <> b.cluster GROUP BY a.cluster""",
    "cosine_dispersion": f"""WITH {_CENT} SELECT cluster, {r6("max(1 - list_cosine_similarity(x, centroid))")} AS max_dispersion,
        {r6("quantile_cont(1 - list_cosine_similarity(x, centroid), 0.95)")} AS p95_dispersion FROM emb JOIN cent USING (cluster) GROUP BY cluster""",
    "cosine_centroid_gap": f"""WITH {_CENT} SELECT a.cluster, {r6("min(1 - list_cosine_similarity(a.centroid, b.centroid))")} AS dist_to_nearest_centroid
        FROM cent a JOIN cent b ON a.cluster <> b.cluster GROUP BY a.cluster""",
    "silhouette": f"WITH {EMB}, {_SIL} SELECT id, cluster, {r6('s')} AS s FROM sil",
    "silhouette_risk": f"WITH {EMB}, {_SIL} SELECT cluster, {r6('quantile_cont(s, 0.05)')} AS p5_silhouette, {r6('avg(CAST(s < 0 AS DOUBLE))')} AS frac_at_risk FROM sil GROUP BY cluster",
    "cluster_summary_join": f"""WITH {PRED}, {_knn(_COS)}, s AS (SELECT dst, count(*) AS n FROM knn GROUP BY 1),
        h AS (SELECT cluster, any_value(class) AS cluster_class, avg(coalesce(n, 0)) AS hub FROM emb LEFT JOIN s ON dst = id GROUP BY cluster),
        t AS (SELECT class, 64.0 / count(*) AS t2 FROM emb GROUP BY class),
        er AS (SELECT cluster, count(*) AS n, avg(CAST(y <> p AS DOUBLE)) AS rate FROM pred WHERE id % 3 = 0 GROUP BY 1)
        SELECT cluster, cluster_class, {r6("hub")} AS cluster_hub, {r6("t2")} AS class_t2, {r6("rate")} AS failure_rate, coalesce(er.n, 0) AS n_test
        FROM h LEFT JOIN t ON t.class = cluster_class LEFT JOIN er USING (cluster)""",
}
