"""Queries of problems 7 to 9: token ids, leaked passages and abusive texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import abuse, bpe, leak
from gneiss.plans.scratch import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    ranks = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), ranks)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that share ten successive words with them."""
    return _leaks(spark, sf_dir).filter("exact_windows > 0").select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that hold a ten-word passage of theirs with at most one word edited."""
    leaks = _leaks(spark, sf_dir)
    return leaks.withColumn("share", F.round(F.col("windows") / F.col("n_windows"), 6))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite and split: items, leaked items, documents that hold them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "split")
    hits = _leaks(spark, sf_dir).filter("exact_windows > 0")
    return (
        items.join(hits, "item_id", "left")
        .groupBy("suite", "split")
        .agg(
            F.count_distinct("item_id").alias("n_items"),
            F.count_distinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"),
            F.count_distinct("doc_id").alias("n_documents"),
        )
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are abusive, hateful or sexual rather than not."""
    return _scores(spark, sf_dir).filter("score >= 0.5").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, worst passage and evidence."""
    return _scores(spark, sf_dir)


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, flagged documents, their share, mean score."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        source.join(_scores(spark, sf_dir).select("doc_id", "score"), "doc_id")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.count_if(F.col("score") >= 0.5).alias("n_flagged"),
            F.round(F.avg((F.col("score") >= 0.5).cast("double")), 6).alias("share_flagged"),
            F.round(F.avg("score"), 6).alias("mean_score"),
        )
    )


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p8_leaks, p8_report, p9_found, p9_scores, p9_report)}

_SHARED = r"""
  iw AS (SELECT item_id, suite, split, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM eval_items),
  dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w)) AS w FROM documents),
  ig AS (SELECT DISTINCT item_id, list_aggregate(w[i:i+9], 'string_agg', ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM iw)),
  dg AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i+9], 'string_agg', ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM dw)),
  hits AS (SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g))"""

ORACLE = {
    "p8_found": f"WITH {_SHARED} SELECT item_id, doc_id FROM hits",
    "p8_report": f"""WITH {_SHARED} SELECT suite, split, count(DISTINCT i.item_id) AS n_items,
        count(DISTINCT h.item_id) AS n_leaked, count(DISTINCT h.doc_id) AS n_documents
        FROM eval_items i LEFT JOIN hits h USING (item_id) GROUP BY suite, split""",
}
