"""Points prepared for the vector operators: valid, one per id, unit length, equal directions grouped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.scratch import broadcast_if, keyed_join, materialize


def unit_points(df: DataFrame, dims: int, *, id_col: str = "point_id", vec_col: str = "x_num") -> DataFrame:
    """id, unit (the bytes of ``dims`` doubles) of the points that take part.

    A vector that is null, of another length, all zero, or holds a null, NaN or infinite
    element takes no part, nor does a null id. Rows repeated under one id count once (the
    smallest vector). Directions are kept to 12 decimals, so that scaled copies are equal.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))

    def scaled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = matrix(b.column("v"), dims)
            # by the largest element first: squares neither overflow nor vanish
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = np.round(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), 12) + 0.0
            yield pa.RecordBatch.from_arrays([b.column("id"), packed(x)], ["id", "unit"])

    return rows.mapInArrow(scaled, "id bigint, unit binary")


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists, or of bytes of doubles, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_binary(column.type):
        if not len(column):
            return np.zeros((0, dims))
        lo = np.frombuffer(column.buffers()[1], np.int32, 1, column.offset * 4)[0]
        return np.frombuffer(column.buffers()[2], np.float64, len(column) * dims, lo).reshape(-1, dims)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def direction(unit: Column) -> list[Column]:
    """Two hashes that stand for a direction in joins."""
    return [F.xxhash64(unit).alias("d1"), F.xxhash64(F.lit(1), unit).alias("d2")]


def shared_directions(points: DataFrame, keep: int) -> tuple[DataFrame, int, int]:
    """(d1, d2, id, n, members) of the directions of more than one point, how many there are, and their points: the smallest id, the number of points and the ``keep`` smallest ids.

    Only hashes and ids are shuffled, and the ranking stops at ``keep`` rows in every task, so a direction of a third of all points is no heavier than others.
    """
    keyed = points.select("id", *direction(F.col("unit")))
    shared = keyed.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = materialize(shared)
    many, total = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = Window.partitionBy("d1", "d2").orderBy("id")
    rows = keyed.join(broadcast_if(shared.select("d1", "d2"), many, 16), ["d1", "d2"], "left_semi")
    first = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
    members = first.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return materialize(shared.join(members, ["d1", "d2"]).select("d1", "d2", F.col("first").alias("id"), "n", "members")), many, total


def directions(points: DataFrame, keep: int) -> DataFrame:
    """d1, d2, id, unit, members: one row per direction, by its smallest id, with its ``keep`` smallest ids."""
    shared, many, total = shared_directions(points, keep)
    keyed = points.select(*direction(F.col("unit")), "id", "unit")
    alone = keyed_join(keyed, shared.select("d1", "d2", "n"), ["d1", "d2"], "n", total, how="left_anti")
    first = keyed.join(broadcast_if(shared.select("id", "members"), many, 16 + 8 * keep), "id")
    return alone.withColumn("members", F.array("id")).unionByName(first.select("d1", "d2", "id", "unit", "members"))
