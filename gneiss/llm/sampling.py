"""Samples whose category shares follow given targets (problem 1).

Method: count the categories of every pool, allocate integer quotas by largest
remainder with minimum floors and availability caps, take the rows with the
smallest random keys of every category, report shortfalls.

Counting pre-aggregates before its shuffle, a quota is decided from the counts
of one configuration's targets alone, and the draw ranks salted parts of a
category before it ranks their survivors, so no task ever holds a hot category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.clean import norm_label
from gneiss.plans.scratch import broadcast_if, materialize

#: Bits of a key that number its slice.
SLICE_BITS = 10


def allocate(n: int, shares: np.ndarray, floors: np.ndarray, available: np.ndarray, shrink: bool = False) -> np.ndarray:
    """Integer quotas that sum to ``n`` as far as floors and availability allow.

    Shares are normalised to sum 1. A quota is at least ``min(floor, available)`` and at
    most ``available``; floors come before ``n``. With ``shrink`` the total is first lowered to the
    largest size at which no available category misses its share. Remainders
    go to the largest fraction, ties to the earlier category.
    """
    shares = np.where(np.isfinite(shares) & (shares > 0), shares, 0.0)
    cap = np.maximum(available, 0)
    low = np.minimum(np.maximum(floors, 0), cap)
    total = shares.sum()
    if total <= 0 or n <= 0:
        return low.astype(np.int64)
    shares = np.where(shares > 0, np.maximum(shares / total, 1e-12), 0.0)
    if shrink and (live := (shares > 0) & (cap > 0)).any():
        n = min(n, int((cap[live] / shares[live]).min() + 1e-9))
    n = int(min(max(n, low.sum()), np.where(shares > 0, cap, low).sum()))
    lo, hi = 0.0, float(cap.sum() / shares[shares > 0].min() + 1)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(mid * shares, low, cap).sum() < n else (lo, mid)
    ideal = np.clip(hi * shares, low, cap)
    quota = np.floor(ideal + 1e-9).astype(np.int64)
    rest = n - int(quota.sum())
    if rest > 0:
        order = np.argsort(-np.where(quota < cap, ideal - quota, -1.0), kind="stable")
        quota[order[:rest]] += 1
    return quota


def train_rows(flows: DataFrame) -> DataFrame:
    """row_id, pool_id, attack, label of the train rows; a repeated row_id counts once, by its first delivery."""
    rows = flows.filter(F.col("split") == "train").filter(F.col("row_id").isNotNull())
    one = F.min(F.struct("ingested_at", "pool_id", norm_label(F.col("attack")).alias("attack"), "label"))
    return rows.groupBy("row_id").agg(one.alias("r")).select("row_id", "r.pool_id", "r.attack", "r.label")


def category_counts(rows: DataFrame) -> DataFrame:
    """pool_id, label_col, category, available: both labels from one pre-aggregated count; rows without a category are left out."""
    counts = rows.groupBy("pool_id", "attack", "label").agg(F.count(F.lit(1)).alias("n"))
    long = counts.select(
        "pool_id",
        F.expr("stack(2, 'attack', attack, 'label', cast(label as string)) as (label_col, category)"),
        "n",
    ).filter(F.col("category").isNotNull())
    return long.groupBy("pool_id", "label_col", "category").agg(F.sum("n").alias("available"))


def _configs(configs: DataFrame) -> DataFrame:
    one = F.min(F.struct("pool_id", "label_col", "balance", "n_samples", "seed"))
    return configs.groupBy("config_id").agg(one.alias("c")).select("config_id", "c.*")


def _match(category: Column) -> Column:
    return norm_label(category)


def quota_report(configs: DataFrame, targets: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per target: what its pool has, what was wanted, its quota and whether it falls short.

    Columns: config_id, pool_id, label_col, balance, n_samples, seed, category, target_share, min_rows,
    available, quota, falls_short. Repeated targets count once; a null share or
    minimum counts as 0; a category the pool lacks has 0 available. Configurations
    without ``n_samples``, or with balance none or null, get no quota and no shortfall.
    Targets of an unknown configuration are dropped.
    """
    t = targets.select("config_id", "category", "target_share", "min_rows").groupBy("config_id", "category").agg(
        F.min(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("min_rows", F.lit(0)).alias("m"))).alias("t")
    )
    joined = (
        _configs(configs)
        .join(t, "config_id")
        .withColumn("_m", _match(F.col("category")))
        .join(counts.withColumnRenamed("category", "_m"), ["pool_id", "label_col", "_m"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
    )
    head = ["config_id", "pool_id", "label_col", "balance", "n_samples", "seed"]
    # The targets of one configuration make one row; their number is that of the target table, not of the data.
    packed = joined.groupBy(*head).agg(
        F.array_sort(
            F.collect_list(F.struct("category", F.col("t.s").alias("s"), F.col("t.m").alias("m"), "available"))
        ).alias("x")
    )

    def quotas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, balance, x in zip(pdf["n_samples"], pdf["balance"], pdf["x"]):
                if pd.isna(n) or balance not in ("target", "undersample"):
                    out.append([None] * len(x))
                    continue
                s, m, a = (np.array([r[k] for r in x], float) for k in ("s", "m", "available"))
                # targets that spell one category twice share what there is
                out.append([int(q) for q in allocate(int(n), s, m, a, shrink=balance == "undersample")])
            pdf["quotas"] = out
            yield pdf

    schema = packed.schema.simpleString()[7:-1] + ",quotas:array<bigint>"
    done = packed.mapInPandas(quotas, schema)
    flat = done.select(*head, F.explode(F.arrays_zip("x", "quotas")).alias("z")).select(
        *head,
        F.col("z.x.category").alias("category"),
        F.col("z.x.s").alias("target_share"),
        F.col("z.x.m").alias("min_rows"),
        F.col("z.x.available").alias("available"),
        F.col("z.quotas").alias("quota"),
    )
    asked = F.col("n_samples").isNotNull() & F.col("balance").isin("target", "undersample")
    short = (F.col("available") < F.col("min_rows")) | (F.col("available") < F.col("n_samples") * F.col("target_share"))
    return flat.withColumn("falls_short", F.coalesce(asked & short, F.lit(False)))


def draw(configs: DataFrame, report: DataFrame, rows: DataFrame) -> DataFrame:
    """config_id, row_id, category of every drawn row.

    Configurations with balance target or undersample and targets draw their quotas; all others
    with ``n_samples`` draw that many rows of their pool at random (category null).
    Keys are hashes of row, seed and configuration: the draw is the same at any partitioning.
    """
    # a small table: one row per target
    quotas = materialize(
        report.filter(F.col("quota") > 0).select(
            "config_id", "pool_id", "label_col", "seed", _match(F.col("category")).alias("category"), "quota"
        )
    )
    n = quotas.count()
    drawn = []
    for label_col, value in (("attack", F.col("attack")), ("label", F.col("label").cast("string"))):
        q = broadcast_if(quotas.filter(F.col("label_col") == label_col).drop("label_col"), n, 96)
        drawn.append(rows.select("row_id", "pool_id", value.alias("category")).join(q, ["pool_id", "category"]))
    with_quota = report.filter(F.col("quota").isNotNull()).select("config_id").distinct()
    plain = _configs(configs).filter("n_samples > 0").join(with_quota, "config_id", "left_anti")
    plain = plain.select("config_id", "pool_id", "seed", F.col("n_samples").alias("quota"))
    drawn.append(rows.select("row_id", "pool_id", F.lit(None).cast("string").alias("category")).join(plain, "pool_id"))
    cols = ["config_id", "row_id", "category", "quota", "seed"]
    every = drawn[0].select(*cols).unionByName(drawn[1].select(*cols)).unionByName(drawn[2].select(*cols))
    every = every.withColumn("_key", F.xxhash64("row_id", "seed", "config_id")).withColumn("_slice", F.shiftright("_key", 64 - SLICE_BITS))
    # the slice of keys in which a quota ends: all smaller keys are drawn, and only that slice's rows are ranked
    group = Window.partitionBy("config_id", "category").orderBy("_slice")
    sizes = every.groupBy("config_id", "category", "quota", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    last = sizes.withColumn("_upto", F.sum("_n").over(group)).filter(F.col("_upto") - F.col("_n") < F.col("quota"))
    last = last.groupBy("config_id", "category").agg(F.max_by(F.struct("_slice", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("left")), "_slice").alias("_last"))
    n_groups = n + plain.count()
    # one row per target or configuration
    cut = broadcast_if(last.withColumnsRenamed({"config_id": "_id", "category": "_category"}), n_groups, 64)
    every = every.join(cut, (F.col("config_id") == F.col("_id")) & F.col("category").eqNullSafe(F.col("_category")))
    whole = every.filter(F.col("_slice") < F.col("_last._slice"))
    w = Window.partitionBy("config_id", "category").orderBy("_key", "row_id")
    part = every.filter(F.col("_slice") == F.col("_last._slice")).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.col("_last.left"))
    cols = ["config_id", "row_id", "category"]
    return whole.select(*cols).unionByName(part.select(*cols))
