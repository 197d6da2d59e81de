"""Ranks, quantiles and random orders over a whole table without a task that holds it.

Values are counted first (combined before the shuffle, so a value of a third of all rows is one row), then cut into ranges. What
lies before a range is the sum over the ranges before it, one row each; inside a range a window does the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.scratch import broadcast_if, keyed_join, materialize


def _placed(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``values`` (by, value, _n) with ``_before``, the rows of smaller values of the same ``by``, and ``_place``, the number of the value, from 0."""
    tasks = max(values.sparkSession.sparkContext.defaultParallelism, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = materialize(values)  # the ranges are sampled from it, which would count twice
    cut = materialize(values.repartitionByRange(tasks, *by, value).withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r0"), F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_v0"))
    inside = Window.partitionBy(*by, "_range").orderBy(value)
    out = cut.join(F.broadcast(sizes), [*by, "_range"])  # one row per range and per border of groups inside one
    before = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") + F.col("_r0")
    place = F.row_number().over(inside) - 1 + F.col("_v0")
    return out.select(*by, value, "_n", before.alias("_before"), place.alias("_place"))


def value_places(df: DataFrame, value: str) -> DataFrame:
    """value, _n, _before, _place: every distinct value with its rows, the rows of smaller values and its number among the values. Nulls have none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    return _placed(counts, [], value)


def with_places(df: DataFrame, value: str) -> DataFrame:
    """``df`` with _n, _before and _place of its rows' values (null for null)."""
    places = materialize(value_places(df, value))
    total = places.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    known = keyed_join(df.filter(F.col(value).isNotNull()), places, [value], "_n", total)
    return known.unionByName(df.filter(F.col(value).isNull()), allowMissingColumns=True)


def quantiles(df: DataFrame, exprs: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """The exact quantiles of every expression, linear between neighbours; None where all its values are null or NaN.

    All expressions share one pass; two values per quantile reach the driver.
    """
    if not exprs:
        return {}
    names = list(exprs)
    long = df.select(F.posexplode(F.array(*[e.cast("double") for e in exprs.values()])).alias("_c", "_v"))
    counts = long.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    places = materialize(_placed(counts, ["_c"], "_v"))
    sizes = {r["_c"]: r["n"] for r in places.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}
    wanted = [(c, k) for c, n in sizes.items() for s in shares for k in {math.floor(s * (n - 1)), math.ceil(s * (n - 1))}]
    if not wanted:
        return {name: None for name in names}
    ask = F.broadcast(df.sparkSession.createDataFrame(sorted(set(wanted)), "_c int, _k bigint"))  # two rows a quantile
    hit = places.join(ask, "_c").filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_before") + F.col("_n")))
    at = {(r["_c"], r["_k"]): r["_v"] for r in hit.select("_c", "_k", "_v").collect()}
    out: dict[str, list[float] | None] = {}
    for c, name in enumerate(names):
        if c not in sizes:
            out[name] = None
            continue
        row = []
        for s in shares:
            x = s * (sizes[c] - 1)
            lo, hi = at[c, math.floor(x)], at[c, math.ceil(x)]
            row.append(lo if lo == hi else lo + (hi - lo) * (x - math.floor(x)))
        out[name] = row
    return out


def random_ranks(df: DataFrame, by: list[Column], order: Column, tie: Column) -> DataFrame:
    """``df`` with _rank, the place of every row in its group by ``order`` (a hexadecimal hash), ties by ``tie``; from 1.

    The hash's first two digits cut a group into 256 slices, so no task orders a whole group.
    """
    names = [f"_by{i}" for i in range(len(by))]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(by, names)], order.alias("_order")).withColumn("_slice", F.substring("_order", 1, 2))
    sizes = materialize(keyed.groupBy(*names, "_slice").agg(F.count(F.lit(1)).alias("_n")))
    earlier = Window.partitionBy(*names).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    starts = broadcast_if(starts, sizes.count(), 64)
    same = F.col("_slice") == F.col("_s")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    place = F.row_number().over(Window.partitionBy(*names, "_slice").orderBy("_order", tie))
    out = keyed.withColumn("_in", place).join(starts, same).withColumn("_rank", F.col("_start") + F.col("_in"))
    return out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns], "_rank")
