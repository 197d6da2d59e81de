"""Tables in the shared checkpoint folder, and broadcasts behind a size check.

A long lineage is cut by writing a Parquet table into the folder that the
session names in ``spark.checkpoint.dir`` and reading it back: the files are
shared by all executors, so losing an executor loses nothing.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The session's shared scratch folder.

    Where none is set, a local session gets one of its own; on a cluster, whose executors
    share no temporary folder, that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "gneiss-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch folder and return the table read back.

    The schema is passed on reading, so an empty table keeps its columns. discard() deletes the table, clear() all of the application's.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gneiss-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(at) or ():
        fs.delete(found.getPath(), True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no result still reads."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results that haven't been written or collected are lost."""
    _delete(spark, f"{scratch_dir(spark)}/gneiss-{spark.sparkContext.applicationId}-*")


def broadcast_if(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is within ``limit``; else leave the join to the planner."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def keyed_join(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, *, how: str = "inner", parts: int = 1000) -> DataFrame:
    """``rows`` joined (inner or left_anti) with ``side``, one row per key, none of whose keys gathers its rows in one task.

    ``side`` has in ``count`` how many rows a key has at most. Keys with more than a ``parts``-th of ``total`` are broadcast, the others
    are shuffled; so the broadcast has fewer than ``parts`` times the counts' sum over ``total`` rows.
    """
    hot = F.col(count) > max(total // parts, 1)
    frequent, common = side.filter(hot), side.filter(~hot)
    others = rows.join(F.broadcast(frequent.select(*keys)), keys, "left_anti")
    if how == "left_anti":
        return others.join(common.select(*keys), keys, "left_anti")
    return rows.join(F.broadcast(frequent), keys).unionByName(others.join(common, keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
