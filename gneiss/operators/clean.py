"""Row cleaning: missing values, predicates, rare categories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.clean import finite, quoted

_FLOATS = ("double", "float")


def drop_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Make NaN and infinities null in every float column, then drop rows with a null in any of ``cols``."""
    out = df.select(*[finite(quoted(c)).alias(c) if t in _FLOATS else quoted(c) for c, t in df.dtypes])
    keep = F.lit(True)
    for c in cols:
        keep = keep & quoted(c).isNotNull()
    return out.filter(keep)


def predicate_sql(query: str) -> str:
    """A predicate in the data-frame dialect (``==``, ``in [..]``, ``and/or/not``, back-ticks) as SQL."""
    if "@" in re.sub(r"'[^']*'|\"[^\"]*\"", "", query):
        raise ValueError("variables in predicates are not supported")
    parts = re.split(r"('[^']*'|\"[^\"]*\"|`[^`]*`)", query)
    for i in range(0, len(parts), 2):
        parts[i] = parts[i].replace("==", "=").replace("[", "(").replace("]", ")").replace("&", " and ").replace("|", " or ")
    return "".join("'" + p[1:-1].replace("'", "''") + "'" if p[:1] == '"' else p for p in parts)


def query_filter(df: DataFrame, query: str | None) -> DataFrame:
    """Rows that satisfy the predicate; null or empty predicates pass everything. The filter reaches the scan."""
    return df.filter(F.expr(predicate_sql(query))) if query else df


def rare_category_filter(df: DataFrame, cat_cols: list[str], min_count: int | None) -> DataFrame:
    """Drop rows whose category occurs fewer than ``min_count`` times, column after column.

    Counts are taken again after each column. Null categories are kept. The rare
    values are the small side of each anti-join, so a hot category is never shuffled.
    """
    if not min_count:
        return df
    for c in cat_cols:
        rare = df.filter(quoted(c).isNotNull()).groupBy(quoted(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        rare = rare.filter(F.col("_n") < min_count).select("_v")
        df = df.join(rare, quoted(c) == rare["_v"], "left_anti")
    return df


def absorb_small(df: DataFrame, cluster: str, floor: int, noise: int = -1) -> DataFrame:
    """Give the noise id to clusters of fewer than ``floor`` rows."""
    sizes = df.groupBy(quoted(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(F.broadcast(sizes.filter(F.col("_n") < floor).select("_c")), quoted(cluster) == F.col("_c"), "left")
    return joined.withColumn(cluster, F.when(F.col("_c").isNotNull(), F.lit(noise)).otherwise(quoted(cluster))).drop("_c")


