"""Deterministic samples and splits.

Rows are ordered by a hash of their key and a seed, so the same rows are drawn whatever the
partitioning. md5 serves where another engine must draw the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.clean import quoted
from gneiss.plans.order import random_ranks
from gneiss.plans.scratch import materialize

#: Up to so many rows of a group are held by one task; it changes the plan, never the rows.
FEW = 10_000


def order_key(key: str, seed: int = 42) -> Column:
    """A random but repeatable order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), quoted(key).cast("string")))


def _ranked(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``_rank`` added: the place of every row in the random order of its group; no task orders a whole group."""
    return random_ranks(df, [quoted(c) for c in by], order_key(key, seed), quoted(key))


def sample_per_group(df: DataFrame, by: list[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each group. For few rows a window does, whose limit is applied before the shuffle as well."""
    if n > FEW:
        return _ranked(df, by, key, seed).filter(F.col("_rank") <= n).drop("_rank")
    w = Window.partitionBy(*[quoted(c) for c in by]).orderBy(order_key(key, seed), quoted(key))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of every class as the smallest class has; null labels are no class."""
    sizes = df.filter(quoted(label).isNotNull()).groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n")).first()[0] or 0
    return sample_per_group(df.filter(quoted(label).isNotNull()), [label], least, key, seed)


def subsample(df: DataFrame, n: int, key: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows, or with a label ``n`` divided by the number of classes from each class."""
    if label is None:
        return df.orderBy(order_key(key, seed), quoted(key)).limit(n)
    classes = df.select(quoted(label)).distinct().count()
    return sample_per_group(df, [label], n // max(classes, 1), key, seed)


def stratified_split(
    df: DataFrame, label: str, key: str, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42
) -> DataFrame:
    """``split`` column: each class cut exactly at rounded shares of its size, train first, then val of the rest."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    n = F.col("_n")
    first = F.floor(n * train + 0.5)
    second = first + F.floor((n - first) * (val / (val + test) if val + test else 0) + 0.5)
    ranked = _ranked(df, [label], key, seed).join(F.broadcast(_sizes(df, label)), quoted(label).eqNullSafe(F.col("_c")))  # one row per class
    ranked = ranked.withColumn("_first", first).withColumn("_second", second)
    name = F.when(F.col("_rank") <= F.col("_first"), "train").when(F.col("_rank") <= F.col("_second"), "val").otherwise("test")
    return ranked.withColumn("split", name).drop("_rank", "_first", "_second", "_c", "_n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``fold`` column 0..k-1, each class dealt evenly; ``k`` is lowered to the rarest class, below 2 raises."""
    rarest = df.groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
    k = min(k, rarest)
    if k < 2:
        raise ValueError("a class has fewer than two rows")
    return _ranked(df, [label], key, seed).withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def _sizes(df: DataFrame, by: str) -> DataFrame:
    """_c, _n: one row per group."""
    return df.groupBy(quoted(by).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))


def cluster_quotas(sizes: DataFrame, budget: int, floor: int) -> DataFrame:
    """_c, _take from (_c, _n), one row per cluster: its rounded share of the budget, at least ``floor`` and at most all.

    What the quotas exceed the budget by comes off the largest first, each down to the floor: with the clusters in falling order, a
    cluster gives what the running sum of spare rows before it has left over.
    """
    total = sizes.agg(F.sum("_n").alias("_total"))
    share = F.rint(F.lit(budget) * F.col("_n") / F.col("_total"))
    asked = sizes.join(F.broadcast(total)).withColumn("_want", F.least("_n", F.greatest(F.lit(floor), share)).cast("bigint"))
    asked = asked.withColumn("_spare", F.greatest(F.col("_want") - max(floor, 1), F.lit(0)))
    by_size = Window.orderBy(F.desc("_want"), "_c")  # one row per cluster
    owed = F.sum("_want").over(Window.partitionBy()) - budget
    before = F.sum("_spare").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    given = F.least("_spare", F.greatest(owed - F.coalesce(before, F.lit(0)), F.lit(0)))
    return asked.select("_c", (F.col("_want") - given).alias("_take"))


def cluster_subsample(df: DataFrame, cluster: str, key: str, budget: int, floor: int = 50, seed: int = 42) -> DataFrame:
    """A subsample stratified by cluster; all rows where they fit the budget. Null clusters take no part beyond the budget."""
    sizes = materialize(_sizes(df, cluster))
    if (sizes.agg(F.sum("_n")).first()[0] or 0) <= budget:
        return df
    take = cluster_quotas(sizes, budget, floor)
    ranked = _ranked(df, [cluster], key, seed).join(F.broadcast(take), quoted(cluster) == F.col("_c"))
    return ranked.filter(F.col("_rank") <= F.col("_take")).drop("_rank", "_c", "_take")


def proportional_cap(df: DataFrame, cluster: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    """At most about ``budget`` rows, every cluster by its share and with one row at least."""
    sizes = materialize(_sizes(df, cluster))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    if total <= budget:
        return df
    take = F.greatest(F.lit(1), F.floor(F.col("_n") * budget / F.lit(total)))
    ranked = _ranked(df, [cluster], key, seed).join(F.broadcast(sizes), quoted(cluster).eqNullSafe(F.col("_c")))
    return ranked.filter(F.col("_rank") <= take).drop("_rank", "_c", "_n")
