"""Centroids, nearest-centroid joins, adversaries and the mixed-type k-NN join.

Points are (id, class, cluster, x [, cats]); x is an array of doubles. Distances run in NumPy over
Arrow batches; the table that every row meets is sent in blocks of a bounded
size, so neither memory nor the broadcast grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.encode import l2_normalise
from gneiss.plans.scratch import materialize

BLOCK_BYTES = 32 << 20
QUERY_ROWS = 512
#: Rows of a block of an all-pairs comparison, and numbers held at once within one.
PAIR_ROWS = 8192
TILE = 1 << 22


def centroids(points: DataFrame, by: str, *, spherical: bool = False) -> DataFrame:
    """``by``, centroid: the mean vector; under ``spherical`` the normalised mean of normalised vectors.

    Partial sums per dimension are combined before the shuffle.
    """
    x = l2_normalise(F.col("x")) if spherical else F.col("x")
    long = points.select(by, F.posexplode(x).alias("f", "v"))
    means = long.groupBy(by, "f").agg(F.avg("v").alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("f", "m"))), lambda s: s["m"])
    out = means.groupBy(by).agg(vec.alias("centroid"))
    return out.withColumn("centroid", l2_normalise(F.col("centroid"))) if spherical else out


def _pack(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.array(pdf[col].tolist(), float).reshape(len(pdf), -1)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        return 1 - a @ b.T
    out = np.empty((len(a), len(b)))
    for lo in range(0, len(a), QUERY_ROWS):
        out[lo : lo + QUERY_ROWS] = np.sqrt(((a[lo : lo + QUERY_ROWS, None, :] - b[None]) ** 2).sum(axis=2))
    return out


def nearest_centroid(points: DataFrame, cents: DataFrame, key: str, *, metric: str = "euclidean", within_class: bool = False) -> DataFrame:
    """``assigned`` and ``dist`` added: each point's nearest centroid, ties to the smallest ``key``.

    ``cents``: key, centroid and, with ``within_class``, class. A class without a centroid gets -1 and a null distance.
    The centroids (at most one per cluster) are sent in blocks of bounded size and the best of all blocks is kept.
    """
    rows = cents.orderBy(key).toLocalIterator()
    size, block, best = 0, [], None

    def met(block: list) -> DataFrame:
        sent = points.sparkSession.sparkContext.broadcast(
            (np.array([r[key] for r in block]), np.array([r["centroid"] for r in block], float), np.array([r["class"] if within_class else 0 for r in block]))
        )

        def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, mat, cls = sent.value
            for pdf in it:
                if not len(pdf):
                    continue
                d = distances(_pack(pdf, "x"), mat, metric)
                if within_class:
                    d = np.where(pdf["class"].to_numpy()[:, None] == cls[None], d, np.inf)
                at = d.argmin(axis=1)
                dist = d[np.arange(len(pdf)), at]
                yield pd.DataFrame({"id": pdf["id"], "assigned": np.where(np.isfinite(dist), keys[at], -1), "dist": np.where(np.isfinite(dist), dist, np.nan)})

        return points.select("id", "x", *["class"] * within_class).mapInPandas(batches, "id bigint, assigned bigint, dist double")

    parts = []
    for r in rows:
        block.append(r)
        size += 8 * len(r["centroid"])
        if size > BLOCK_BYTES:
            parts.append(met(block))
            size, block = 0, []
    if block:
        parts.append(met(block))
    if not parts:
        return points.withColumn("assigned", F.lit(-1).cast("bigint")).withColumn("dist", F.lit(None).cast("double"))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    if len(parts) > 1:
        best = best.groupBy("id").agg(F.min_by("assigned", F.struct(F.coalesce(F.nanvl("dist", F.lit(None)), F.lit(1e308)), "assigned")).alias("assigned"), F.min(F.nanvl("dist", F.lit(None))).alias("dist"))
    return points.join(best.withColumn("dist", F.nanvl("dist", F.lit(None))), "id")


def adversaries(cents: DataFrame, k: int, *, metric: str = "euclidean") -> DataFrame:
    """c, j, rank, dist: for each cluster the ``k`` nearest centroids of another class, ties to the smaller id.

    ``cents``: cluster, class, centroid; one row per cluster, so the join is of bounded tables.
    """
    a = cents.select(F.col("cluster").alias("c"), F.col("class").alias("_ca"), F.col("centroid").alias("_a"))
    b = F.broadcast(cents.select(F.col("cluster").alias("j"), F.col("class").alias("_cb"), F.col("centroid").alias("_b")))
    if metric == "cosine":
        dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        norms = [F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)) for c in ("_a", "_b")]
        dist = 1 - dot / (norms[0] * norms[1])
    else:
        dist = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    w = Window.partitionBy("c").orderBy("dist", "j")
    pairs = a.join(b, F.col("_ca") != F.col("_cb")).select("c", "j", dist.alias("dist"))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def block_pairs(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, rows: int = PAIR_ROWS) -> DataFrame:
    """``run`` on every pair of a block of ``left`` and a block of ``right``; both have an ``id``.

    Blocks are drawn by the id's hash, of at most about ``rows`` rows and small enough to give every core a pair. The plan is one join of blocks however many
    rows there are; each row is sent once for every block of the other side, the least that an exact comparison of all rows takes.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n = [max(1, math.ceil(df.count() / rows), math.ceil(cores**0.5)) for df in (left, right)]
    own = [F.pmod(F.xxhash64("id"), F.lit(k)).cast("int") for k in n]
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in n]
    a = left.withColumn("_a", own[0]).withColumn("_b", every[1])
    b = right.withColumn("_b", own[1]).withColumn("_a", every[0])
    tasks = min(n[0] * n[1], 32 * cores)
    sides = [df.repartition(tasks, "_a", "_b").groupBy("_a", "_b") for df in (a, b)]

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        return run(x, y)

    return sides[0].cogroup(sides[1]).applyInArrow(both, schema)


def rows_matrix(t: pa.Table, col: str) -> np.ndarray:
    """A list column as a matrix, one row of the table per row."""
    c = t.column(col).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def mixed_distances(q: np.ndarray, base: np.ndarray, q_cats: np.ndarray | None, base_cats: np.ndarray | None, metric: str) -> np.ndarray:
    """Distances of all rows of two tiles under the mixed distance of knn_graph; numbers come normalised or divided by their ranges."""
    d_num = q.shape[1]
    if metric == "cosine":
        squares = np.add.outer((q**2).sum(axis=1), (base**2).sum(axis=1))
        d = np.clip(squares / 2 - q @ base.T, 0, 1) * d_num
    else:
        d = np.abs(q[:, None, :] - base[None]).sum(axis=2)
    n_cats = 0 if q_cats is None else q_cats.shape[1]
    if n_cats:
        d += (q_cats[:, None, :] != base_cats[None]).sum(axis=2)
    return np.round(d / (d_num + n_cats), 12)


def scaled_points(points: DataFrame, metric: str) -> DataFrame:
    """``x`` divided by its length (cosine) or each feature by its range, as the mixed distance takes it."""
    if metric == "cosine":
        return points.withColumn("x", l2_normalise(F.col("x")))
    spans = points.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.greatest(F.max("v") - F.min("v"), F.lit(1e-8)).alias("r"))
    one = spans.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "r"))), lambda s: s["r"]).alias("_r"))  # one row
    return points.join(F.broadcast(one)).withColumn("x", F.zip_with("x", "_r", lambda v, r: v / r)).drop("_r")


def nearest_rows(dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` smallest finite entries of every row, ties to the smaller id."""
    kth = np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1 :][:, :1]
    row, col = np.nonzero((dist <= kth) & np.isfinite(dist))
    order = np.lexsort((ids[col], dist[row, col], row))
    row, col = row[order], col[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def knn_graph(points: DataFrame, k: int, *, metric: str = "cosine", n_cats: int = 0) -> DataFrame:
    """src, dst, rank, dist: the exact ``k`` nearest neighbours of every point under the mixed distance.

    cosine: the numeric part is half the squared distance of the normalised vectors, cut to 0..1 and weighted
    by the number of features; otherwise range-normalised absolute differences. Differing categories
    (``cats``) add 1 each; the sum is divided by the number of columns. The point itself is left out,
    ties go to the smaller id. Every pair of blocks yields its queries' k best, and the best of those are kept.
    """
    base = materialize(scaled_points(points.select("id", "x", *["cats"] * bool(n_cats)), metric))

    def best(q: pa.Table, b: pa.Table) -> pa.Table:
        mine, ids = q.column("id").to_numpy(), b.column("id").to_numpy()
        src, dst, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(mine) and len(ids):
            x, y = rows_matrix(q, "x"), rows_matrix(b, "x")
            xc, yc = (rows_matrix(q, "cats"), rows_matrix(b, "cats")) if n_cats else (None, None)
            step = QUERY_ROWS if metric == "cosine" else max(1, TILE // (len(ids) * x.shape[1]))
            for lo in range(0, len(mine), step):
                some = slice(lo, lo + step)
                d = mixed_distances(x[some], y, xc[some] if n_cats else None, yc, metric)
                d[mine[some, None] == ids] = np.inf
                row, col = nearest_rows(d, ids, k)
                src.append(mine[some][row])
                dst.append(ids[col])
                dist.append(d[row, col])
        return pa.table({"src": np.concatenate(src), "dst": np.concatenate(dst), "dist": np.concatenate(dist)})

    found = block_pairs(base, base, best, "src bigint, dst bigint, dist double")
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("src", "dst", "rank", "dist")
