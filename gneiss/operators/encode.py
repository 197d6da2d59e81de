"""Fitted column transforms: fit on the train rows, apply to all.

Fits aggregate to one row (or one row per category) and are applied as
literals or as broadcast joins of bounded tables, so transforming is a map.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.clean import finite, quoted
from gneiss.plans.order import quantiles


def log_squash(c: Column, epsilon: float = 1e-10) -> Column:
    """log(1 + max(x, 0) + epsilon)."""
    return F.log1p(F.greatest(c, F.lit(0.0)) + epsilon)


@dataclass(frozen=True)
class RobustScaler:
    """Median and interquartile range per column; a zero range scales by 1."""

    center: dict[str, float | None]
    spread: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, cols: list[str], prepare=finite) -> RobustScaler:
        """Exact quantiles of the train rows; missing values are left out."""
        found = quantiles(train, {c: prepare(quoted(c)) for c in cols}, [0.25, 0.5, 0.75])
        center, spread = {}, {}
        for c, q in found.items():
            lo, mid, hi = q or (None, None, None)
            center[c], spread[c] = mid, (hi - lo) or 1.0 if q else 1.0
        return cls(center, spread)

    def apply(self, c: str, value: Column) -> Column:
        mid = self.center[c]
        return F.lit(None).cast("double") if mid is None else (value - F.lit(mid)) / F.lit(self.spread[c])


def log_robust_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` squashed by the logarithm and robust-scaled with the train rows' statistics; others pass through."""
    scaler = RobustScaler.fit(train, cols, lambda c: log_squash(finite(c)))
    return df.select(*[scaler.apply(c, log_squash(finite(quoted(c)))).alias(c) if c in cols else quoted(c) for c in df.columns])


def impute_robust_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values of ``cols`` replaced by the train median, then robust-scaled with train statistics after imputing."""
    medians = {c: q and q[0] for c, q in quantiles(train, {c: finite(quoted(c)) for c in cols}, [0.5]).items()}
    filled = {c: F.coalesce(finite(quoted(c)), F.lit(medians[c])) for c in cols}
    scaler = RobustScaler.fit(train.select(*[filled[c].alias(c) for c in cols]), cols)
    return df.select(*[scaler.apply(c, filled[c]).alias(c) if c in cols else quoted(c) for c in df.columns])


def top_values(train: DataFrame, c: str, top_n: int) -> DataFrame:
    """value, code 1..top_n: the most frequent values, ties by value; at most ``top_n`` rows."""
    counts = train.filter(quoted(c).isNotNull()).groupBy(quoted(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(top_n)
    return top.select("value", F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("code"))


def stable_bucket(key: str, column: str, value: str, buckets: int) -> int:
    """Bucket of an out-of-vocabulary value: 8-byte blake2b of key, column and value."""
    digest = hashlib.blake2b(f"{key}|{column}|{value}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") % buckets


def top_n_encode(df: DataFrame, train: DataFrame, cols: list[str], top_n: int, buckets: int = 0, key: str = "") -> DataFrame:
    """Integer codes: missing 0, the train rows' ``top_n`` values 1..top_n, others ``1 + top_n + bucket`` (0 without buckets).

    Only distinct unknown values reach Python for their hash.
    """
    for c in cols:
        top = F.broadcast(top_values(train, c, top_n).withColumnsRenamed({"value": "_v", "code": "_code"}))
        joined = df.join(top, quoted(c) == F.col("_v"), "left")
        code = F.coalesce("_code", F.lit(0))
        if buckets:

            def hashed(it, c=c):
                for pdf in it:
                    yield pd.DataFrame({"_o": pdf["_o"], "_h": [1 + top_n + stable_bucket(key, c, v, buckets) for v in pdf["_o"]]})

            unknown = df.select(quoted(c).cast("string").alias("_o")).filter(F.col("_o").isNotNull()).distinct()
            unknown = unknown.join(top.select(F.col("_v").cast("string").alias("_o")), "_o", "left_anti").mapInPandas(hashed, "_o string, _h int")
            joined = joined.join(unknown, quoted(c).cast("string") == F.col("_o"), "left")
            code = F.coalesce("_code", "_h", F.lit(0))
        df = joined.select(*[code.cast("int").alias(c) if n == c else quoted(n) for n in df.columns])
    return df


def label_encode(df: DataFrame, train: DataFrame, src: str, dst: str) -> DataFrame:
    """``dst``: position of the label among the train rows' sorted labels; an unknown label raises when its row is read."""
    classes = [r[0] for r in train.select(quoted(src)).distinct().filter(quoted(src).isNotNull()).orderBy(quoted(src)).collect()]
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), quoted(src)) - 1
    bad = F.raise_error(F.concat(F.lit(f"unknown label in {src}: "), F.coalesce(quoted(src).cast("string"), F.lit("null"))))
    return df.withColumn(dst, F.when(code >= 0, code).otherwise(bad.cast("bigint")))


def capped_category(df: DataFrame, train: DataFrame, cols: list[str], cap: int = 255) -> DataFrame:
    """Keep the train rows' ``cap`` most frequent values of each column, others become null."""
    for c in cols:
        top = F.broadcast(top_values(train, c, cap).select(F.col("value").alias("_v")))
        joined = df.join(top, quoted(c) == F.col("_v"), "left")
        df = joined.select(*[F.col("_v").alias(c) if n == c else quoted(n) for n in df.columns])
    return df


def one_hot(df: DataFrame, train: DataFrame, c: str, limit: int = 256) -> DataFrame:
    """``c`` replaced by one 0/1 column per train value (at most ``limit``), named ``c=value``; unknown values are all 0."""
    values = [r[0] for r in top_values(train, c, limit).orderBy("value").collect()]
    return df.select(
        *[quoted(n) for n in df.columns if n != c],
        *[F.coalesce((quoted(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}={v}") for v in values],
    )


def l2_normalise(x: Column, eps: float = 1e-8) -> Column:
    """A vector divided by its length, or by ``eps`` if that is longer."""
    length = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)), F.lit(eps))
    return F.transform(x, lambda v: v / length)
