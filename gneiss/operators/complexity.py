"""Complexity measures of a partition of points into clusters (or classes).

Every pairwise measure compares cluster ``c`` with its adversary ``j``; pairs come from
``geometry.adversaries``. Points are (id, cluster, x), k-NN edges (src, dst, rank, dist). Measures are grouped aggregates over
long tables, so a large cluster is summed in parts, not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators import geometry
from gneiss.operators.boruvka import spanning_forest
from gneiss.plans.scratch import materialize

EPS = 1e-8


def feature_stats(points: DataFrame) -> DataFrame:
    """cluster, f, n, mu, var (population), lo, hi: one pass over all features."""
    long = points.select("cluster", F.posexplode("x").alias("f", "v"))
    return long.groupBy("cluster", "f").agg(
        F.count("v").alias("n"), F.avg("v").alias("mu"), F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def _pair_stats(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    own = stats.filter("n > 1").select(F.col("cluster").alias("c"), "f", *[F.col(x).alias(f"{x}_c") for x in ("mu", "var", "lo", "hi")])
    other = stats.filter("n > 1").select(F.col("cluster").alias("j"), "f", *[F.col(x).alias(f"{x}_j") for x in ("mu", "var", "lo", "hi")])
    return pairs.select("c", "j").join(own, "c").join(other, ["j", "f"])


def fisher_and_volume(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """c, j, f1, f2: Fisher ratio turned to overlap, and mean overlap of the features' ranges."""
    p = _pair_stats(pairs, stats)
    ratio = F.pow(F.col("mu_c") - F.col("mu_j"), 2) / (F.col("var_c") + F.col("var_j") + EPS)
    overlap = F.greatest(F.lit(0.0), F.least("hi_c", "hi_j") - F.greatest("lo_c", "lo_j"))
    span = F.greatest("hi_c", "hi_j") - F.least("lo_c", "lo_j") + EPS
    return p.groupBy("c", "j").agg((1 / (1 + F.max(ratio))).alias("f1"), F.avg(overlap / span).alias("f2"))


def overlap_shares(points: DataFrame, pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """c, j, f3, f4: least share of c's points inside a feature's overlap, and the share inside all of them (0 when one is empty)."""
    p = _pair_stats(pairs, stats).select("c", "j", "f", F.greatest("lo_c", "lo_j").alias("lo"), F.least("hi_c", "hi_j").alias("hi"))
    bounds = p.groupBy("c", "j").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "lo", "hi"))), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("b")
    )
    inside = F.zip_with("x", "b", lambda v, b: (v >= b["lo"]) & (v <= b["hi"]))
    each = points.select(F.col("cluster").alias("c"), "x").join(bounds, "c").select("c", "j", inside.alias("in"))
    flags = each.select("c", "j", F.forall("in", lambda v: v).cast("int").alias("all"), F.posexplode("in").alias("f", "one"))
    per = flags.groupBy("c", "j", "f").agg(F.avg(F.col("one").cast("double")).alias("share"), F.avg("all").alias("all"))
    return per.groupBy("c", "j").agg(F.min("share").alias("f3"), F.max("all").alias("f4"))


def neighbour_votes(edges: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """c, j, src, vc, vj, dc, dj, first_j: of each point of c, its neighbours in c and in j, the nearest of each, and whether j's comes first.

    ``members``: id, cluster. Points without a neighbour in c or j are kept with zero votes.
    """
    src = members.select(F.col("id").alias("src"), F.col("cluster").alias("c"))
    dst = members.select(F.col("id").alias("dst"), F.col("cluster").alias("dc_"))
    by_cluster = edges.join(dst, "dst").groupBy("src", "dc_").agg(F.count(F.lit(1)).alias("v"), F.min("dist").alias("d"), F.min("rank").alias("r"))
    base = src.join(pairs.select("c", "j"), "c")
    own = by_cluster.withColumnsRenamed({"dc_": "c", "v": "vc", "d": "dc", "r": "rc"})
    other = by_cluster.withColumnsRenamed({"dc_": "j", "v": "vj", "d": "dj", "r": "rj"})
    joined = base.join(own, ["src", "c"], "left").join(other, ["src", "j"], "left")
    return joined.select(
        "c", "j", "src", F.coalesce("vc", F.lit(0)).alias("vc"), F.coalesce("vj", F.lit(0)).alias("vj"), "dc", "dj",
        F.coalesce(F.col("rj") < F.coalesce("rc", F.lit(1 << 30)), F.lit(False)).alias("first_j"),
    )


def neighbourhood(votes: DataFrame, k: int) -> DataFrame:
    """c, j, n2, n3, n4, network_density: 0, not null, where no point has a fitting neighbour."""
    some = (F.col("vc") + F.col("vj")) > 0
    return votes.groupBy("c", "j").agg(
        F.coalesce(F.avg(F.col("dc") / (F.col("dc") + F.col("dj") + EPS)), F.lit(0.0)).alias("n2"),
        F.coalesce(F.try_divide(F.count_if(F.col("first_j")), F.count_if(some)), F.lit(0.0)).alias("n3"),
        F.coalesce(F.try_divide(F.count_if(F.col("vj") > F.col("vc")), F.count_if(some)), F.lit(0.0)).alias("n4"),
        (F.sum("vj") / (F.count(F.lit(1)) * k)).alias("network_density"),
    )


def borderline(tree: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """c, j, n1: share of c's points that a spanning-tree edge joins to j. ``tree``: u, v."""
    both = tree.select("u", "v").union(tree.select("v", "u")).toDF("u", "v")
    own = members.select(F.col("id").alias("u"), F.col("cluster").alias("c"))
    other = members.select(F.col("id").alias("v"), F.col("cluster").alias("j"))
    touched = both.join(own, "u").join(other, "v").groupBy("c", "j").agg(F.count_distinct("u").alias("t"))
    sizes = members.groupBy(F.col("cluster").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("c", "j").join(touched, ["c", "j"], "left").join(sizes, "c").select("c", "j", (F.coalesce("t", F.lit(0)) / F.col("n")).alias("n1"))


def clustering_coefficient(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, cls_coef: mean share of a point's ordered pairs of neighbours in its cluster that are neighbours."""
    own = members.select(F.col("id").alias("src"), "cluster")
    inner = edges.select("src", "dst").join(own, "src").join(members.select(F.col("id").alias("dst"), F.col("cluster").alias("k2")), "dst")
    inner = inner.filter(F.col("cluster") == F.col("k2")).select("src", "dst", "cluster")
    hop = inner.select("src", F.col("dst").alias("mid")).join(inner.select(F.col("src").alias("mid"), F.col("dst").alias("end")), "mid")
    closed = hop.join(inner.select("src", F.col("dst").alias("end")), ["src", "end"], "left_semi")
    t = closed.groupBy("src").agg(F.count(F.lit(1)).alias("t"))
    z = inner.groupBy("src").agg(F.count(F.lit(1)).alias("z"))
    per = own.join(z, "src", "left").join(t, "src", "left")
    value = F.when(F.col("z") > 1, F.coalesce("t", F.lit(0)) / (F.col("z") * (F.col("z") - 1))).otherwise(0.0)
    return per.groupBy("cluster").agg(F.avg(value).alias("cls_coef"))


def hubness(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, hub: mean number of points that have a point of the cluster as neighbour."""
    seen = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return members.join(seen, "id", "left").groupBy("cluster").agg(F.avg(F.coalesce("n", F.lit(0))).alias("hub"))


def density_ratio(members: DataFrame, d_num: int, d_cat: int) -> DataFrame:
    """cluster, t2: columns per point."""
    return members.groupBy("cluster").agg((F.lit(float(d_num + d_cat)) / F.count(F.lit(1))).alias("t2"))


def pca_ratios(points: DataFrame, share: float = 0.95) -> DataFrame:
    """cluster, t3, t4: principal components for ``share`` of the variance, per point and per feature; null below two points.

    Second moments are summed per partition and cluster, so only d x d matrices are gathered.
    """

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in it:
            for c, rows in pdf.groupby("cluster"):
                x = np.array(rows["x"].tolist(), float)
                n, mean = len(x), x.mean(axis=0)
                scatter = (x - mean).T @ (x - mean)
                if c in held:  # pairwise update keeps precision
                    n0, mean0, scatter0 = held[c]
                    delta = mean - mean0
                    scatter = scatter + scatter0 + np.outer(delta, delta) * n * n0 / (n + n0)
                    mean, n = (mean * n + mean0 * n0) / (n + n0), n + n0
                held[c] = n, mean, scatter
        for c, (n, mean, scatter) in held.items():
            yield pd.DataFrame({"cluster": [c], "n": [n], "mean": [mean], "scatter": [scatter.ravel()]})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = 0, 0.0, 0.0
        for _, r in pdf.sort_values("n").iterrows():
            m, s = np.array(r["mean"]), np.array(r["scatter"])
            delta = m - mean
            scatter = scatter + s + (np.outer(delta, delta) * n * r["n"] / (n + r["n"])).ravel() if n else s
            mean, n = (mean * n + m * r["n"]) / (n + r["n"]), n + r["n"]
        d = len(mean)
        if n < 2 or d < 1:
            t3 = t4 = None
        elif d == 1:
            t3, t4 = 1 / n, 1.0
        else:
            values = np.clip(np.linalg.eigvalsh(scatter.reshape(d, d))[::-1], 0, None)
            total = values.sum()
            parts = min(int(np.searchsorted(np.cumsum(values) / total, share)) + 1, n, d) if total > 0 else 1
            t3, t4 = parts / n, parts / d
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "t3": [t3], "t4": [t4]})

    kind = dict(points.dtypes)["cluster"]
    partial = points.select("cluster", "x").mapInPandas(sums, f"cluster {kind}, n bigint, mean array<double>, scatter array<double>")
    return partial.groupBy("cluster").applyInPandas(merged, f"cluster {kind}, t3 double, t4 double")


def _distance(a: str, b: str, metric: str) -> Column:
    if metric == "cosine":
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        length = [F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, v: s + v * v)) for c in (a, b)]
        return 1 - F.coalesce(F.try_divide(dot, length[0] * length[1]), F.lit(0.0))
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def dispersion(points: DataFrame, cents: DataFrame, *, metric: str = "euclidean") -> DataFrame:
    """cluster, max_dispersion, p95_dispersion: distances to the own centroid."""
    joined = points.select("cluster", "x").join(F.broadcast(cents.select("cluster", "centroid")), "cluster").select("cluster", _distance("x", "centroid", metric).alias("d"))
    return joined.groupBy("cluster").agg(F.max("d").alias("max_dispersion"), F.percentile("d", 0.95).alias("p95_dispersion"))


def centroid_gap(cents: DataFrame, *, metric: str = "euclidean") -> DataFrame:
    """cluster, dist_to_nearest_centroid: of any class; null with a single cluster."""
    a = cents.select("cluster", F.col("centroid").alias("a"))
    b = F.broadcast(cents.select(F.col("cluster").alias("k2"), F.col("centroid").alias("b")))
    gap = a.join(b, F.col("cluster") != F.col("k2")).groupBy("cluster").agg(F.min(_distance("a", "b", metric)).alias("dist_to_nearest_centroid"))
    return cents.select("cluster").join(gap, "cluster", "left")


def with_noise_rows(measures: DataFrame, noise: DataFrame) -> DataFrame:
    """``measures`` with is_noise_cluster false, and one row per cluster of ``noise`` that has only the flag."""
    own = measures.withColumn("is_noise_cluster", F.lit(False))
    return own.unionByName(noise.select("cluster").distinct().withColumn("is_noise_cluster", F.lit(True)), allowMissingColumns=True)


def silhouette(points: DataFrame, block_rows: int = 8192, *, metric: str = "euclidean") -> DataFrame:
    """id, cluster, s: exact silhouette by Euclidean or cosine distance; a single member scores 0, one cluster gives null.

    Every pair of blocks yields distance sums per point and cluster; sums add up over blocks.
    """
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))

    def totals(q: pa.Table, b: pa.Table) -> pa.Table:
        ids, names = q.column("id").to_numpy(), np.zeros(0, np.int64)
        out = np.zeros((len(ids), 0))
        if len(ids) and b.num_rows:
            names, code = np.unique(b.column("cluster").to_numpy(), return_inverse=True)
            x, base = geometry.rows_matrix(q, "x"), geometry.rows_matrix(b, "x")
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(names)))
            tiles = [np.add.reduceat(geometry.distances(x[lo : lo + 512], base, metric)[:, order], starts, axis=1) for lo in range(0, len(x), 512)]
            out = np.concatenate(tiles)
        return pa.table({"id": np.repeat(ids, len(names)), "other": np.tile(names, len(ids)), "total": out.ravel()})

    rows = materialize(points.select("id", F.col("cluster").cast("bigint").alias("cluster"), "x"))
    sums = geometry.block_pairs(rows, rows, totals, "id bigint, other bigint, total double", rows=block_rows)
    sums = sums.groupBy("id", "other").agg(F.sum("total").alias("total")).join(F.broadcast(sizes.withColumnRenamed("cluster", "other")), "other")
    own = points.select("id", "cluster")
    per = own.join(sums, "id")
    mine = F.col("other") == F.col("cluster")
    both = per.groupBy("id", "cluster").agg(
        F.max(F.when(mine, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"),
        F.max(F.when(mine, F.col("n"))).alias("n"),
    )
    s = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return both.select("id", "cluster", s.alias("s"))


def silhouette_measures(scores: DataFrame) -> DataFrame:
    """cluster, p5_silhouette, frac_at_risk."""
    return scores.groupBy("cluster").agg(
        F.percentile("s", 0.05).alias("p5_silhouette"), F.avg((F.col("s") < 0).cast("double")).alias("frac_at_risk")
    )


def min_mean_max(pairs: DataFrame, clusters: DataFrame, measures: list[str]) -> DataFrame:
    """cluster and each measure's least, mean and greatest value over adversaries; null without any."""
    agg = [f(m).alias(f"{m}_{n}") for m in measures for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return clusters.select("cluster").join(pairs.groupBy(F.col("c").alias("cluster")).agg(*agg), "cluster", "left")


def spanning_tree(edges: DataFrame, points: DataFrame, *, metric: str = "cosine", n_cats: int = 0) -> DataFrame:
    """u, v, w: minimum spanning tree of the symmetrised k-NN graph, zero-length links left out, its parts joined to the first.

    The forest comes from Boruvka rounds. The smallest id's part is the first; from that id a link goes to the nearest point
    of every other part under the graph's own mixed distance, of at least 1e-10, ties to the smaller id. ``points``: id, x [, cats].
    """
    links = edges.filter("dist > 0").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("w"))
    forest, parts = spanning_forest(links)
    rows = scaled = geometry.scaled_points(points.select("id", "x", *["cats"] * bool(n_cats)), metric)
    rows = rows.join(parts, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    hub = F.broadcast(scaled.orderBy("id").limit(1).select(F.col("id").alias("u"), F.col("x").alias("_x"), *[F.col("cats").alias("_cats")] * bool(n_cats)))  # one row
    d = F.aggregate(F.zip_with("x", "_x", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / 2
    d = F.least(d, F.lit(1.0)) * F.size("x") if metric == "cosine" else F.aggregate(F.zip_with("x", "_x", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    if n_cats:
        d = d + F.aggregate(F.zip_with("cats", "_cats", lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda s, v: s + v)
    gap = F.greatest(d / (F.size("x") + n_cats), F.lit(1e-10))
    first = rows.join(hub, F.col("id") == F.col("u"), "left_semi").select(F.col("comp").alias("_first"))
    others = rows.join(F.broadcast(first), F.col("comp") == F.col("_first"), "left_anti")
    near = others.join(hub).groupBy("u", "comp").agg(F.min(F.struct(gap.alias("w"), F.col("id").alias("v"))).alias("e"))
    return forest.unionByName(near.select("u", "e.v", "e.w"))
