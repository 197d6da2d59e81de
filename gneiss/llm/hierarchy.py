"""The condensed hierarchy of a mutual-reachability forest and its most stable clusters (problem 3).

The hierarchy is condensed exactly, at every merge of the spanning forest. A component is worked out in one task from its nodes
and edges alone (some hundred bytes a direction), many components side by side. ``levels`` reads it
at a fixed number of distance levels instead. The components of every level then come from
the spanning forest alone, finest level first: each coarser level only joins components
by the edges between two levels, and sizes, splits, stabilities and the choice of clusters are grouped
sums and joins over (point, level) or over the clusters, so no component is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.density import BLOCK, graph
from gneiss.llm.vectors import direction
from gneiss.operators.boruvka import spanning_forest
from gneiss.plans.scratch import materialize

#: Distances are rounded to 9 decimals; what is at distance 0 counts as this near.
LEAST = 1e-9


def level_components(edges: DataFrame, ids: DataFrame, thresholds: list[float]) -> DataFrame:
    """id, c0, c1, ...: each id's component at every threshold, given in falling order; c0 belongs to the largest."""
    edges = materialize(edges)
    last = len(thresholds) - 1
    labels = ids.select("id", F.col("id").alias(f"c{last + 1}"))
    below = -1.0
    for i in range(last, -1, -1):
        band = edges.filter((F.col("w") > below) & (F.col("w") <= thresholds[i])).select("u", "v", "w")
        now = labels.select("id", F.col(f"c{i + 1}").alias("c"))
        for end in ("u", "v"):
            band = band.join(now.select(F.col("id").alias(end), F.col("c").alias("_c")), end).drop(end).withColumnRenamed("_c", end)
        _, joined = spanning_forest(band.select("u", "v", "w"))
        joined = joined.select(F.col("id").alias(f"c{i + 1}"), "comp")
        labels = materialize(labels.join(joined, f"c{i + 1}", "left").withColumn(f"c{i}", F.coalesce("comp", f"c{i + 1}")).drop("comp"))
        below = thresholds[i]
    return labels.drop(f"c{last + 1}")


def condensed(points: DataFrame, thresholds: list[float], min_size: int) -> DataFrame:
    """id, k0, k1, ...: the cluster of the condensed hierarchy that each point is in at every level, null once it has fallen out.

    A component with two or more large parts at the next level splits into new clusters; with one, it
    goes on as that part; with none, it ends. A cluster is named by its first level and component.
    """
    n = len(thresholds)
    out = points
    for i in range(n):
        size = out.groupBy(f"c{i}").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).select(f"c{i}")
        if i == 0:
            names = size.withColumn("k0", F.concat(F.lit("0:"), F.col("c0").cast("string")))
        else:
            # one row per large component of this level
            up = out.join(size, f"c{i}", "left_semi").groupBy(f"c{i}").agg(F.any_value(f"k{i - 1}").alias("up"))
            parts = up.groupBy("up").agg(F.count(F.lit(1)).alias("parts"))
            name = F.when(F.col("parts") > 1, F.concat(F.lit(f"{i}:"), F.col(f"c{i}").cast("string"))).otherwise(F.col("up"))
            names = up.filter("up is not null").join(parts, "up").select(f"c{i}", name.alias(f"k{i}"))
        out = materialize(out.join(names, f"c{i}", "left"))
    return out.select("id", *[f"k{i}" for i in range(n)])


def stable_clusters(chain: DataFrame, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, depth) of the points in the chosen clusters, and (cluster, stability) of those.

    A cluster's stability is the sum over its points of the densities (inverse distances) from its first level to
    the last at which the point is still in it. A cluster is chosen if it is more stable than the best choice among
    the clusters it splits into, and none above it is chosen. depth is the point's last level in the cluster.
    """
    n = len(thresholds)
    density = [1.0 / t for t in thresholds]
    each = chain.select("id", F.posexplode(F.array(*[f"k{i}" for i in range(n)])).alias("level", "cluster")).filter("cluster is not null")
    stay = each.groupBy("id", "cluster").agg(F.min("level").alias("first"), F.max("level").alias("last"))
    stay = materialize(stay)
    lam = F.array(*[F.lit(x) for x in density])
    born = F.get(lam, F.split_part("cluster", F.lit(":"), F.lit(1)).cast("int"))
    own = stay.groupBy("cluster").agg(F.sum(F.get(lam, F.col("last")) - born).alias("stability"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id").orderBy("first")
    up = stay.withColumn("parent", F.lag("cluster").over(w)).groupBy("cluster").agg(F.any_value("parent").alias("parent"))
    nodes = materialize(own.join(up, "cluster").withColumn("level", F.split_part("cluster", F.lit(":"), F.lit(1)).cast("int")))
    # bottom up: the best total below and at every cluster
    done = None
    for i in range(n - 1, -1, -1):
        at = nodes.filter(F.col("level") == i)
        if done is None:
            best = at.withColumn("below", F.lit(0.0))
        else:
            below = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
            best = at.join(below, "cluster", "left").withColumn("below", F.coalesce("below", F.lit(0.0)))
        best = best.withColumn("best", F.greatest("stability", "below"))
        done = materialize(best if done is None else done.unionByName(best))
    # top down: the first cluster of every branch that is worth its parts
    wanted = done.withColumn("worth", F.col("stability") >= F.col("below"))
    chosen, open_ = None, wanted.filter("parent is null")
    for i in range(n):
        take = open_.filter("worth").select("cluster", "stability")
        chosen = take if chosen is None else chosen.unionByName(take)
        rest = open_.filter("not worth").select(F.col("cluster").alias("parent"))
        if i < n - 1:
            open_ = materialize(wanted.join(rest, "parent", "left_semi"))
    chosen = materialize(chosen)
    members = stay.join(chosen.select("cluster"), "cluster", "left_semi").select("id", "cluster", F.col("last").alias("depth"))
    return members, chosen


def condense(ids: np.ndarray, weight: np.ndarray, core: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, reach: float, min_size: int):
    """(node position, cluster number, depth) of the nodes in chosen clusters, and the clusters' stabilities.

    A node stands for ``weight`` points, which part at its core distance. Equal heights merge at once. The rest is as in
    stable_clusters, with every merge a level: depth is the density at which a node falls out of the cluster or the cluster ends.
    """
    n = len(ids)
    floor = np.maximum(core, LEAST)
    height, size, parts = list(floor), list(weight), [()] * n
    find = list(range(n))

    def root(i: int) -> int:
        while find[i] != i:
            find[i] = find[find[i]]
            i = find[i]
        return i

    order = np.argsort(w, kind="stable")
    u, v, w = np.searchsorted(ids, u[order]).tolist(), np.searchsorted(ids, v[order]).tolist(), np.maximum(w[order], LEAST).tolist()
    at = 0
    while at < len(w):
        end, fresh = at, set()
        while end < len(w) and w[end] == w[at]:
            a, b = root(u[end]), root(v[end])
            if a != b:
                c = len(height)
                # nodes made at this height are taken up, not nested
                parts.append(tuple(q for x in (a, b) for q in (parts[x] if x in fresh else (x,))))
                height.append(w[at])
                size.append(size[a] + size[b])
                find[a] = find[b] = c
                find.append(c)
                fresh.add(c)
            end += 1
        at = end
    tops = sorted({root(i) for i in range(n)})
    parent, born, split, stability, kids = [], [], [], [], []
    where, out = np.full(n, -1), np.zeros(n)
    todo = [(t, -1, 1 / reach) for t in tops if size[t] >= min_size]
    while todo:
        node, up, lam = todo.pop()
        me = len(parent)
        parent.append(up)
        born.append(lam)
        kids.append([])
        total = 0.0
        if up >= 0:
            kids[up].append(me)
        while True:
            now = max(1 / height[node], lam)
            if node < n:
                where[node], out[node] = me, now
                total += size[node] * (now - lam)
                break
            big = [q for q in parts[node] if size[q] >= min_size]
            gone = [q for q in parts[node] if size[q] < min_size]
            while gone:
                q = gone.pop()
                if q < n:
                    where[q], out[q] = me, now
                    total += size[q] * (now - lam)
                else:
                    gone += parts[q]
            if len(big) == 1:
                node = big[0]
                continue
            for q in big:
                total += size[q] * (now - lam)
                todo.append((q, me, now))
            break
        split.append(now)
        stability.append(total)
    best, keep = stability.copy(), [True] * len(parent)
    for c in range(len(parent) - 1, -1, -1):  # parts come after their cluster
        below = sum(best[q] for q in kids[c])
        if below > stability[c]:
            keep[c], best[c] = False, below
    chosen = np.full(len(parent), -1)
    for c in range(len(parent)):
        over = chosen[parent[c]] if parent[c] >= 0 else -1
        chosen[c] = over if over >= 0 else c if keep[c] else -1
    own = np.where(where >= 0, chosen[where] if len(parent) else -1, -1)
    row = np.flatnonzero(own >= 0)
    depth = np.minimum(out[row], np.array(split)[own[row]]) if len(row) else out[row]
    return row, own[row], depth, np.array(stability)


def exact_clusters(nodes: DataFrame, edges: DataFrame, labels: DataFrame, reach: float, min_size: int) -> DataFrame:
    """id, cluster, stability, depth: the nodes (id, core, n) in the most stable clusters of the forest ``edges`` with components ``labels``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(it)
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        node, edge = rows[~rows["e"]].sort_values("u"), rows[rows["e"]]
        ids = node["u"].to_numpy()
        row, own, depth, stability = condense(
            ids, node["n"].to_numpy(), node["w"].to_numpy(), edge["u"].to_numpy(), edge["v"].to_numpy(), edge["w"].to_numpy(), reach, min_size
        )
        out = pd.DataFrame({"id": ids[row], "cluster": own, "stability": stability[own], "depth": depth})
        out["cluster"] = out.groupby("cluster")["id"].transform("min")
        yield out

    known = nodes.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    known = materialize(known.select("comp", "id", "core", "n"))
    large = materialize(known.groupBy("comp").agg(F.sum("n").alias("total")).filter(F.col("total") >= min_size).select("comp"))
    links = edges.join(labels.withColumnRenamed("id", "u"), "u").select("comp", "u", "v", "w", F.lit(0).cast("bigint").alias("n"))
    points = known.select("comp", F.col("id").alias("u"), F.col("id").alias("v"), F.col("core").alias("w"), "n")
    both = points.withColumn("e", F.lit(False)).unionByName(links.withColumn("e", F.lit(True))).join(large, "comp", "left_semi")
    return both.select("comp", "e", "u", "v", "w", "n").repartition("comp").mapInPandas(run, "id bigint, cluster bigint, stability double, depth double")


def density_clusters(
    points: DataFrame, dims: int, *, reach: float = 0.05, min_samples: int = 5, min_size: int = 5, levels: int | None = None, exemplars: int = 5, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(point_id, y_cluster) and (cluster_id, n_points, stability, exemplars).

    ``y_cluster`` is the cluster's smallest point id, -1 for noise. Exemplars are the members that stay longest, the
    densest first, ties by id. Without ``levels`` every merge counts. ``points`` are unit_points, so points that take no part have no row.
    """
    nodes, links = graph(points, dims, reach, min_samples, block=block, heights=True)
    nodes = nodes.select("id", "d1", "d2", "core")
    forest, parts = spanning_forest(links)
    keyed = points.select("id", *direction(F.col("unit")))
    if levels is None:
        count = keyed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
        found = materialize(exact_clusters(nodes.join(count, ["d1", "d2"]).select("id", "core", "n"), forest, parts, reach, min_size))
        own = nodes.select("d1", "d2", F.col("id").alias("node"), "core").join(found.withColumnRenamed("id", "node"), "node", "left").drop("node")
        every = materialize(keyed.join(own, ["d1", "d2"]).drop("d1", "d2"))
        members = every.filter("cluster is not null").select("id", "cluster", "depth")
        return _named(every, members, found.select("cluster", "stability").distinct(), exemplars)
    thresholds = [reach * (levels - i) / levels for i in range(levels)]
    comps = level_components(forest, nodes, thresholds)
    own = nodes.select("d1", "d2", F.col("id").alias("node"), "core").join(comps.withColumnRenamed("id", "node"), "node").drop("node")
    every = materialize(keyed.join(own, ["d1", "d2"]).drop("d1", "d2"))
    members, chosen = stable_clusters(condensed(every.drop("core"), thresholds, min_size), thresholds)
    return _named(every, members, chosen, exemplars)


def _named(every: DataFrame, members: DataFrame, chosen: DataFrame, exemplars: int) -> tuple[DataFrame, DataFrame]:
    """The results of density_clusters from (id, core), (id, cluster, depth) and (cluster, stability)."""
    members = materialize(members)
    ids = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("n_points"))
    ids = materialize(ids.join(chosen, "cluster"))
    named = members.join(ids.select("cluster", "cluster_id"), "cluster").select("id", "depth", "cluster_id")
    labels = every.select("id").join(named, "id", "left").select(F.col("id").alias("point_id"), F.coalesce("cluster_id", F.lit(-1)).alias("y_cluster"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("depth"), "core", "id")
    typical = named.join(every.select("id", "core"), "id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= exemplars)
    typical = typical.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]).alias("exemplars"))
    return labels, ids.join(typical, "cluster_id").select("cluster_id", "n_points", "stability", "exemplars")
