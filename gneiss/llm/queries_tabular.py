"""Queries of problems 1, 5 and 6: samples, frequencies and overlaps of flow records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import overlap, sampling, termcount
from gneiss.plans.scratch import materialize, table
from gneiss.sources.schemas import CAT_COLS, NUM_COLS


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = sampling.train_rows(table(spark, sf_dir, "flow_samples"))
    configs = table(spark, sf_dir, "data_config")
    report = sampling.quota_report(configs, table(spark, sf_dir, "sample_targets"), sampling.category_counts(rows))
    return configs, report, rows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that their pool cannot meet."""
    return _report(spark, sf_dir)[1].filter("falls_short").select("config_id", "category")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with availability, quota and shortfall."""
    return _report(spark, sf_dir)[1].select(
        "config_id", "category", "target_share", "min_rows", "available", "quota", "falls_short"
    )


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn rows of every configuration."""
    configs, report, rows = _report(spark, sf_dir)
    return sampling.draw(configs, materialize(report), rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values too rare or too common to serve as a feature."""
    marks = termcount.value_marks(table(spark, sf_dir, "flow_samples"), "row_id", CAT_COLS)
    return marks.filter("mark is not null").select("cat_col", "cat_value", "mark")


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its counts and mark."""
    return termcount.value_marks(table(spark, sf_dir, "flow_samples"), "row_id", CAT_COLS)


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of up to two neighbouring values of a record, as ``a b``, and their counts."""
    records = termcount.categorical_records(table(spark, sf_dir, "flow_samples"), "row_id", CAT_COLS)
    counts = termcount.sequence_counts(records, "terms", 2)
    return counts.select(F.array_join("gram", " ").alias("gram"), F.size("gram").alias("n"), "occurrences", "records")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.near_rows(table(spark, sf_dir, "flow_samples"), NUM_COLS, CAT_COLS, "attack")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train row and a val or test row that are the same or nearly so."""
    pairs = _overlaps(spark, sf_dir)
    return pairs.select(
        F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")
    )


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: evaluation rows, and those that leak, with the best containment (share of equal fields)."""
    flows = table(spark, sf_dir, "flow_samples").filter(F.col("split").isin("val", "test"))
    held = flows.groupBy(F.col("row_id").alias("eval_id")).agg(F.min("split").alias("split"), F.min("source").alias("source"))
    best = _overlaps(spark, sf_dir).groupBy("eval_id").agg(F.min("n_diff").alias("n_diff"))
    width = len(NUM_COLS) + len(CAT_COLS) + 1
    return (
        held.join(best, "eval_id", "left")
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("n_diff").alias("n_overlapping"),
            F.count_if(F.col("n_diff") == 0).alias("n_same"),
            F.round(F.avg(1 - F.col("n_diff") / width), 6).alias("mean_containment"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_report, p1_sample, p5_found, p5_values, p5_sequences, p6_found, p6_report)
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_P1 = f"""
  tr AS (SELECT row_id, min(pool_id) AS pool_id, min(lower(trim(attack, {_BLANKS}))) AS attack, min(label) AS label
         FROM flow_samples WHERE split = 'train' AND row_id IS NOT NULL GROUP BY row_id),
  cnt AS (SELECT pool_id, 'attack' AS label_col, attack AS m, count(*) AS available FROM tr WHERE attack IS NOT NULL GROUP BY ALL
          UNION ALL
          SELECT pool_id, 'label', CAST(label AS VARCHAR), count(*) FROM tr WHERE label IS NOT NULL GROUP BY ALL),
  tgt AS (SELECT DISTINCT config_id, category, target_share, min_rows FROM sample_targets),
  rep AS (SELECT c.config_id, t.category, c.balance, c.n_samples, t.target_share, t.min_rows, coalesce(n.available, 0) AS available
          FROM data_config c JOIN tgt t USING (config_id)
          LEFT JOIN cnt n ON n.pool_id = c.pool_id AND n.label_col = c.label_col AND n.m = lower(trim(t.category, {_BLANKS})))"""
_MARKS = """
  long AS (SELECT row_id, cat_col, cat_value FROM (
             UNPIVOT (SELECT row_id, {cols} FROM flow_samples) ON {cols} INTO NAME cat_col VALUE cat_value)),
  vals AS (SELECT cat_col, cat_value, count(DISTINCT row_id) AS records FROM long GROUP BY ALL),
  total AS (SELECT count(DISTINCT row_id) AS total FROM flow_samples),
  marked AS (SELECT cat_col, cat_value, records AS occurrences, records,
               CASE WHEN records < 5 THEN 'rare' WHEN records > 0.5 * total THEN 'common' END AS mark
             FROM vals, total)""".format(cols=", ".join(CAT_COLS))


def _fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END AS {c}"


_DIFF = " + ".join(
    [
        f"CASE WHEN (a.{c} IS NULL AND b.{c} IS NULL) OR abs(a.{c} - b.{c}) <= 0.01 * greatest(abs(a.{c}), abs(b.{c})) "
        "THEN 0 ELSE 1 END"
        for c in NUM_COLS
    ]
    + [f"CASE WHEN a.{c} IS NOT DISTINCT FROM b.{c} THEN 0 ELSE 1 END" for c in [*CAT_COLS, "attack"]]
)
_PAIRS = f"""
  f AS (SELECT DISTINCT row_id, split, source, {", ".join(map(_fin, NUM_COLS))}, {", ".join(CAT_COLS)},
          lower(trim(attack, {_BLANKS})) AS attack FROM flow_samples),
  pairs AS (SELECT a.row_id AS train_id, b.row_id AS eval_id, b.split, b.source, {_DIFF} AS n_diff
            FROM f a JOIN f b ON a.split = 'train' AND b.split IN ('val', 'test') AND {_DIFF} <= 2)"""

_TERMS = ", ".join(f"'{c}=' || {c}" for c in CAT_COLS)

ORACLE = {
    "p5_sequences": f"""WITH rec AS (SELECT row_id, any_value(list_filter([{_TERMS}], lambda t: t IS NOT NULL)) AS t FROM flow_samples WHERE row_id IS NOT NULL GROUP BY row_id),
        g AS (SELECT row_id, unnest(t) AS gram, 1 AS n FROM rec
              UNION ALL SELECT row_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 2 FROM rec)
        SELECT gram, n, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM g GROUP BY gram, n""",
    "p1_found": f"""WITH {_P1} SELECT config_id, category FROM rep WHERE n_samples IS NOT NULL
        AND balance IN ('target', 'undersample') AND (available < min_rows OR available < n_samples * target_share)""",
    "p5_found": f"WITH {_MARKS} SELECT cat_col, cat_value, mark FROM marked WHERE mark IS NOT NULL",
    "p5_values": f"WITH {_MARKS} SELECT cat_col, cat_value, occurrences, records, mark FROM marked",
    "p6_found": f"WITH {_PAIRS} SELECT DISTINCT least(train_id, eval_id) AS row_id_a, greatest(train_id, eval_id) AS row_id_b FROM pairs",
    "p6_report": f"""WITH {_PAIRS}, best AS (SELECT eval_id, min(n_diff) AS n_diff FROM pairs GROUP BY eval_id),
        held AS (SELECT row_id AS eval_id, min(split) AS split, min(source) AS source FROM flow_samples
                 WHERE split IN ('val', 'test') GROUP BY row_id)
        SELECT split, source, count(*) AS n_rows, count(n_diff) AS n_overlapping,
          count(*) FILTER (n_diff = 0) AS n_same, round(avg(1 - n_diff / 38.0), 6) AS mean_containment
        FROM held LEFT JOIN best USING (eval_id) GROUP BY split, source""",
}
