"""The adapters through which the queries see the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.scratch import table

DIMS = 64

EMB = "emb AS (SELECT vec_id AS id, label AS class, label * 10 + vec_id % 4 AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def sql_means(name: str, by: str, source: str = "emb") -> str:
    return (
        f"{name} AS (SELECT {by}, list(m ORDER BY f) AS centroid FROM (SELECT {by}, f, avg(x[f]) AS m "
        f"FROM {source}, range(1, {DIMS + 1}) AS r(f) GROUP BY {by}, f) GROUP BY {by})"
    )


PRED = f"""{EMB}, {sql_means("ccent", "class")},
  dk AS (SELECT id, e.class AS y, e.cluster, k.class AS k, list_distance(x, k.centroid) AS d FROM emb e, ccent k),
  pred AS (SELECT id, any_value(y) AS y, any_value(cluster) AS cluster, arg_min(k, d) AS p,
             list(exp(-d) / s ORDER BY k) AS proba
           FROM (SELECT *, sum(exp(-d)) OVER (PARTITION BY id) AS s FROM dk) GROUP BY id),
  clu AS (SELECT cluster, any_value(y) AS class, count(*) AS support, avg(CASE WHEN y <> p THEN 1.0 ELSE 0.0 END) AS rate,
            avg(1 - list_max(proba)) AS score, cluster AS ordinal FROM pred GROUP BY cluster)"""

_FLAG = "CASE WHEN l_orderkey % 10 < 8 THEN 'train' WHEN l_orderkey % 10 = 8 THEN 'val' ELSE 'test' END"
LINES = f"li AS (SELECT *, {_FLAG} AS split FROM lineitem)"


def emb(spark: SparkSession, d: str) -> DataFrame:
    """id, class, cluster, x."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("class"),
        (F.col("label") * 10 + F.col("vec_id") % 4).alias("cluster"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def pred(spark: SparkSession, d: str) -> DataFrame:
    """id, y, cluster, p, proba: the nearest class centroid as prediction, softmax of negative distances."""
    from gneiss.operators.geometry import centroids

    points = emb(spark, d)
    cents = F.broadcast(centroids(points, "class").select(F.col("class").alias("k"), "centroid"))  # one row per class
    dist = F.sqrt(F.aggregate(F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    far = points.crossJoin(cents).select("id", F.col("class").alias("y"), "cluster", "k", dist.alias("d"))
    per = far.groupBy("id", "y", "cluster").agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("a"), F.min_by("k", "d").alias("p"))
    e = F.transform("a", lambda s: F.exp(-s["d"]))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return per.select("id", "y", "cluster", "p", F.transform(e, lambda v: v / total).alias("proba"))


def clu(spark: SparkSession, d: str) -> DataFrame:
    """cluster, class, support, rate, score, ordinal: one row per cluster of pred."""
    p = pred(spark, d)
    return p.groupBy("cluster").agg(
        F.any_value("y").alias("class"),
        F.count(F.lit(1)).alias("support"),
        F.avg((F.col("y") != F.col("p")).cast("double")).alias("rate"),
        F.avg(1 - F.array_max("proba")).alias("score"),
    ).withColumn("ordinal", F.col("cluster"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with a split."""
    k = F.col("l_orderkey") % 10
    return table(spark, d, "lineitem").withColumn("split", F.when(k < 8, "train").when(k == 8, "val").otherwise("test"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree."""
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            out.append((F.round(F.col(c).cast("double"), digits) + 0.0).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"
