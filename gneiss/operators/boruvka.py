"""Minimum spanning forests of edge tables by distributed Boruvka rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.plans.scratch import discard, materialize

LOCAL_EDGES = 50_000
EDGE = "u bigint, v bigint, w double"


def _kruskal(u: np.ndarray, v: np.ndarray, order: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """Positions of the edges of the minimum spanning forest, and the root of every node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    kept = []
    for i in order:
        a, b = root(int(u[i])), root(int(v[i]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(int(i))
    return kept, {x: root(x) for x in list(parent)}


def spanning_forest(edges: DataFrame, *, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """(u, v, w) of the minimum spanning forest, and (id, comp): each linked node's component, by its smallest id.

    Boruvka rounds: every component takes its least outgoing edge (ties by the edge's ids), the chosen edges
    are contracted, and parallel edges are reduced to the least. Once at most ``local_edges`` edges
    between components are left, one task finishes them.
    """
    spark = edges.sparkSession
    lo, hi = F.least("u", "v"), F.greatest("u", "v")
    edges = edges.select(lo.alias("u"), hi.alias("v"), "w").filter("u <> v")
    left = materialize(edges.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    labels = materialize(left.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("comp", F.col("id")))
    picked = []
    n = left.count()
    while n > local_edges:
        both = left.unionByName(left.select("u", "v", "w", F.col("b").alias("a"), F.col("a").alias("b")))
        best = materialize(both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("e")).select("a", "e.*"))
        picked.append(best.select("u", "v", "w").distinct())
        hook = best.select("a", F.col("b").alias("up"))
        back = best.select(F.col("a").alias("up"), F.col("b").alias("back"))
        # where two components chose each other the smaller stays
        parent = materialize(
            hook.join(back, "up").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("up")), F.col("a")).otherwise(F.col("up")).alias("up"))
        )
        held = parent  # the scratch table behind parent
        while True:
            step = parent.join(parent.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select("a", "up", "top")
            step = materialize(step)
            discard(held)
            held, parent = step, step.select("a", F.col("top").alias("up"))
            if step.filter("up <> top").limit(1).count() == 0:
                break
        before = left, labels
        left = _contracted(left, parent)
        labels = materialize(
            labels.join(parent.withColumnRenamed("a", "comp"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        )
        discard(*before, held)
        n = left.count()

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(it), ignore_index=True)
        order = np.lexsort((e["v"], e["u"], e["w"]))
        kept, roots = _kruskal(e["a"].to_numpy(), e["b"].to_numpy(), order)
        yield e.iloc[kept][["u", "v", "w"]].assign(node=-1, top=-1, kind=0)
        yield pd.DataFrame({"u": -1, "v": -1, "w": 0.0, "node": list(roots), "top": list(roots.values()), "kind": 1})

    if n:
        last = materialize(left.repartition(1).mapInPandas(finish, EDGE + ", node bigint, top bigint, kind int"))
        picked.append(last.filter("kind = 0").select("u", "v", "w"))
        tops = last.filter("kind = 1").select(F.col("node").alias("comp"), "top")
        labels = labels.join(tops, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    forest = spark.createDataFrame([], EDGE)
    for p in picked:
        forest = forest.unionByName(p)
    least = labels.groupBy("comp").agg(F.min("id").alias("least"))
    return forest, materialize(labels.join(least, "comp").select("id", F.col("least").alias("comp")))


def _contracted(edges: DataFrame, parent: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(parent.select(F.col("a").alias(end), F.col("up").alias("top")), end, "left")
        edges = edges.withColumn(end, F.coalesce("top", end)).drop("top")
    edges = edges.filter("a <> b").select("u", "v", "w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(
        edges.groupBy("a", "b").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.u", "e.v", "e.w", "a", "b")
    )
