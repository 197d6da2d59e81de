"""Queries of problems 3 and 4: clusters and nearest neighbours of the point cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm import density, forest, hierarchy, vectors
from gneiss.plans.scratch import materialize, table
from gneiss.sources.schemas import NUM_COLS

DIMS = len(NUM_COLS)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(vectors.unit_points(table(spark, sf_dir, "complexity_graph"), DIMS))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of at least 5 points that chains of cosine distances up to 0.05 join."""
    sets = density.linked_sets(_points(spark, sf_dir), DIMS, 0.05, 5)
    return sets.filter("id <> comp").select(F.col("comp").alias("first_id"), F.col("id").alias("point_id"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most stable density cluster of every point that takes part, -1 for noise."""
    return hierarchy.density_clusters(_points(spark, sf_dir), DIMS)[0]


def p3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cluster: id, most frequent class, size, stability and most typical points."""
    labels, clusters = hierarchy.density_clusters(_points(spark, sf_dir), DIMS)
    classes = table(spark, sf_dir, "complexity_graph").groupBy("point_id").agg(F.min("y_class").alias("y_class"))
    counts = labels.filter("y_cluster >= 0").join(classes, "point_id").groupBy("y_cluster", "y_class").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("y_cluster").orderBy(F.desc("n"), "y_class")
    top = counts.withColumn("r", F.row_number().over(w)).filter("r = 1")
    top = top.select(F.col("y_cluster").alias("cluster_id"), F.col("y_class").cast("bigint").alias("cluster_class"))
    return clusters.join(top, "cluster_id", "left").select("cluster_id", "cluster_class", "n_points", F.round("stability", 6).alias("stability"), "exemplars")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 0.05 where one is among the 10 nearest of the other."""
    near = forest.nearest(_points(spark, sf_dir), DIMS, 10, max_dist=0.05)
    pairs = near.select("id", F.explode("near.id").alias("other"))
    return pairs.select(
        F.least("id", "other").alias("point_id_a"), F.greatest("id", "other").alias("point_id_b")
    ).distinct()


def p4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every point that takes part, as knn_idx and knn_dist."""
    near = forest.nearest(_points(spark, sf_dir), DIMS, 10)
    return near.select(
        F.col("id").alias("point_id"),
        F.col("near.id").alias("knn_idx"),
        F.col("near.dist").cast("array<float>").alias("knn_dist"),
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p3_summary, p4_found, p4_knn)}

_UNIT = """
  valid AS (SELECT point_id, min(x_num) AS x FROM complexity_graph
            WHERE len(x_num) = 29 AND len(list_filter(x_num, lambda v: v IS NULL OR NOT isfinite(v))) = 0
              AND len(list_filter(x_num, lambda v: v <> 0)) > 0 GROUP BY point_id),
  unit AS (SELECT point_id, list_transform(x, lambda v: round(v / sqrt(list_dot_product(x, x)), 12)) AS u FROM valid),
  dist AS (SELECT a.point_id AS id, b.point_id AS other, round(1 - list_dot_product(a.u, b.u), 9) AS dist
           FROM unit a JOIN unit b ON a.point_id <> b.point_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM dist)"""

ORACLE = {
    "p3_found": f"""WITH RECURSIVE {_UNIT}, link AS MATERIALIZED (SELECT id, other FROM dist WHERE dist <= 0.05),
        walk AS (SELECT point_id AS id, point_id AS first FROM unit UNION SELECT l.other, w.first FROM walk w JOIN link l ON l.id = w.id),
        comp AS (SELECT id, min(first) AS first_id FROM walk GROUP BY id)
        SELECT first_id, id AS point_id FROM comp QUALIFY count(*) OVER (PARTITION BY first_id) >= 5 AND id <> first_id""",
    "p4_found": f"""WITH {_UNIT} SELECT DISTINCT least(id, other) AS point_id_a, greatest(id, other) AS point_id_b
        FROM near WHERE rank <= 10 AND dist <= 0.05""",
}
