"""Queries on raw exported lines (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.plans.scratch import table
from gneiss.sources.delimited import split_load
from gneiss.sources.schemas import CAT_COLS, NUM_COLS

RAW_COLUMNS = ["flow_key", *NUM_COLS, *CAT_COLS, "attack", "remark"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable lines and the first reason that applies."""
    _, rejects = split_load(table(spark, sf_dir, "raw_flow_lines"), RAW_COLUMNS, NUM_COLS)
    return rejects.select("line_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable lines as typed columns."""
    loaded, _ = split_load(table(spark, sf_dir, "raw_flow_lines"), RAW_COLUMNS, NUM_COLS)
    return loaded


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: lines, rejects by reason."""
    lines = table(spark, sf_dir, "raw_flow_lines")
    _, rejects = split_load(lines, RAW_COLUMNS, NUM_COLS)
    joined = lines.select("line_id", "file_key").join(rejects, "line_id", "left")
    return joined.groupBy("file_key").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count("reason").alias("n_rejected"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("broken_quoting", "column_count", "invalid_value")],
    )


QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p2_report": p2_report}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_CHECKED = rf"""
  lines AS (
    SELECT line_id, file_key, CASE WHEN raw_text LIKE '%' || chr(13) THEN left(raw_text, length(raw_text) - 1)
                         ELSE coalesce(raw_text, '') END AS t
    FROM raw_flow_lines),
  cut AS (
    SELECT line_id, file_key, regexp_full_match(t, '{_FIELD}(?:,{_FIELD})*', 's') AS sound,
           list_transform(regexp_extract_all(',' || t, ',({_FIELD})', 1, 's'),
             lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
    FROM lines),
  checked AS (
    SELECT line_id, file_key, CASE
        WHEN NOT sound THEN 'broken_quoting'
        WHEN len(f) <> 40 THEN 'column_count'
        WHEN len(list_filter(f[2:30], lambda v: NOT regexp_full_match(trim(v, ' '),
             '(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:-?inf|nan))?'))) > 0 THEN 'invalid_value'
        END AS reason, f
    FROM cut)"""

ORACLE = {
    "p2_found": f"WITH {_CHECKED} SELECT line_id, reason FROM checked WHERE reason IS NOT NULL",
    "p2_loaded": f"WITH {_CHECKED} SELECT line_id, "
    + ", ".join(
        f"TRY_CAST(nullif(trim(f[{i + 1}], ' '), '') AS DOUBLE) AS {c}" if c in NUM_COLS else f"nullif(f[{i + 1}], '') AS {c}"
        for i, c in enumerate(RAW_COLUMNS)
    )
    + " FROM checked WHERE reason IS NULL",
    "p2_report": f"""WITH {_CHECKED} SELECT file_key, count(*) AS n_lines, count(reason) AS n_rejected,
        count(*) FILTER (reason = 'broken_quoting') AS broken_quoting,
        count(*) FILTER (reason = 'column_count') AS column_count,
        count(*) FILTER (reason = 'invalid_value') AS invalid_value
        FROM checked GROUP BY file_key""",
}
