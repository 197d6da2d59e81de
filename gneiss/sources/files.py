"""Reading and writing tables, JSON artifacts, stage markers, timings and run trees."""

from __future__ import annotations

import functools
import json
import math
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.functions.clean import quoted


def csv_schema(header: list[str], num_cols: list[str]) -> T.StructType:
    """Declared numbers as doubles, everything else as strings."""
    numeric = set(num_cols)
    return T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in header])


def read_csv(spark: SparkSession, path: str, num_cols: list[str]) -> DataFrame:
    """A CSV with header; ``inf``, ``-inf``, ``nan`` are numbers, empty fields null. No pass for inferring types."""
    header = spark.read.text(path).limit(1).first()
    import csv

    names = next(csv.reader([header[0]])) if header else []
    return spark.read.csv(path, header=True, schema=csv_schema(names, num_cols), positiveInf="inf", negativeInf="-inf", nanValue="nan", enforceSchema=True)


def read_table(spark: SparkSession, path: str, num_cols: list[str] | None = None) -> DataFrame:
    """By extension: .parquet, .orc, .json or .csv (with the declared number columns); others raise."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path, num_cols or [])
    if kind in (".parquet", ".orc", ".json"):
        return getattr(spark.read, kind[1:])(path)
    raise ValueError(f"no reader for {kind or 'a path without extension'}")


def read_listed(spark: SparkSession, base: str, names: list[str]) -> list[DataFrame]:
    return [read_table(spark, os.path.join(base, n)) for n in names]


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    kind = Path(path).suffix.lower()
    if kind not in (".csv", ".parquet", ".orc", ".json"):
        raise ValueError(f"no writer for {kind or 'a path without extension'}")
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    w.csv(path, header=True) if kind == ".csv" else getattr(w, kind[1:])(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every float column, as JSON needs it."""
    return df.select(*[F.nanvl(quoted(c), F.lit(None)).alias(c) if t in ("double", "float") else quoted(c) for c, t in df.dtypes])


def _plain(v):
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return None if isinstance(v, float) and math.isnan(v) else v


def write_json(obj, path: str) -> None:
    """A small artifact as JSON, NaN as null, keys as strings."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(_plain(obj), indent=2))


def read_json(path: str):
    return json.loads(Path(path).read_text())


class ArtifactSink:
    """Artifacts routed by their name's prefix (json/, table/, figure/); other prefixes are ignored."""

    def __init__(self, root: str):
        self.root = root

    def publish(self, items: dict) -> list[str]:
        done = []
        for name, value in items.items():
            prefix, _, rest = name.partition("/")
            path = os.path.join(self.root, prefix, rest)
            if prefix == "json":
                write_json(value, path + ".json")
            elif prefix == "table":
                write_table(value, path + ".parquet")
            elif prefix == "figure":
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                Path(path).write_bytes(value)
            else:
                continue
            done.append(name)
        return done


TIMINGS: list[dict] = []


def timed(f):
    """Wall time of a call that returns a table, with the table computed, added to TIMINGS."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        t = time.perf_counter()
        out = f(*args, **kwargs)
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        TIMINGS.append({"function": f.__name__, "duration_s": time.perf_counter() - t})
        return out

    return run


def flush_timings(path: str) -> None:
    """Append TIMINGS to a JSON list and clear them."""
    old = read_json(path) if os.path.exists(path) else []
    write_json(old + TIMINGS, path)
    TIMINGS.clear()


def stage_done(markers: list[str], force: bool = False) -> bool:
    """Whether every output exists (a table by its _SUCCESS) and the stage may be skipped."""
    return not force and all(os.path.exists(os.path.join(m, "_SUCCESS")) if os.path.isdir(m) else os.path.exists(m) for m in markers)


def parse_dataset_dir(name: str) -> tuple[str, int | None]:
    """``file_seed`` to file and seed; without an all-digit tail the seed is None."""
    head, _, tail = name.rpartition("_")
    return (head, int(tail)) if head and tail.isdigit() else (name, None)


def run_tree(spark: SparkSession, root: str, file: str, schema: T.StructType | None = None) -> DataFrame:
    """One row per run that has ``file``: variant, dataset, seed, classifier from the path, and the JSON's fields.

    Paths are root/variant/dataset_seed/classifier/file; unfinished runs simply lack the file.
    """
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(f"{root}/*/*/*/{file}").withColumn("_path", F.input_file_name())
    part = F.split("_path", "/")
    at = lambda i: F.element_at(part, i)
    folder = at(-3)
    seed = F.regexp_extract(folder, r"^(.+)_([0-9]+)$", 2)
    return df.select(
        at(-4).alias("variant"),
        F.when(seed != "", F.regexp_extract(folder, r"^(.+)_([0-9]+)$", 1)).otherwise(folder).alias("dataset"),
        F.when(seed != "", seed.cast("int")).alias("seed"),
        at(-2).alias("classifier"),
        *[quoted(c) for c in df.columns if c != "_path"],
    )
