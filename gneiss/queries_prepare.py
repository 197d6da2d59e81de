"""Queries on cleaning, encoding, splitting, profiling and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import clean, encode, geometry, joins, metrics, prepare, profile, split
from gneiss.plans.scratch import table
from gneiss.plans.views import EMB, LINES, PRED, emb, lines, pred, r6, rounded, sql_means

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _dirty_events(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    bad = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, float("inf")).when(i % 13 == 0, float("nan")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", "event_type", bad.alias("value"))


def drop_nonfinite(spark, d):
    return clean.drop_nonfinite(_dirty_events(spark, d), ["value"])


def predicate_filter(spark, d):
    q = "l_returnflag == 'R' and l_quantity in [1, 2, 3] and not (l_linestatus == \"O\" or l_discount > 0.05)"
    return clean.query_filter(table(spark, d, "lineitem"), q).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def rare_category_filter(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    n = part.count() // 25
    return clean.rare_category_filter(part, ["p_brand", "p_size"], n // 2 + 1)


def small_cluster_absorb(spark, d):
    points = emb(spark, d).select("id", "cluster")
    return clean.absorb_small(points, "cluster", 12)


def log_robust_scale(spark, d):
    li = lines(spark, d)
    return rounded(encode.log_robust_scale(li, li.filter("split = 'train'"), NUM).select("l_orderkey", "l_linenumber", "split", *NUM))


def median_impute_scale(spark, d):
    li = lines(spark, d)
    li = li.withColumn("l_tax", F.when(F.col("l_partkey") % 5 == 0, None).otherwise(F.col("l_tax")))
    return rounded(encode.impute_robust_scale(li, li.filter("split = 'train'"), ["l_tax", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_tax", "l_quantity"))


def topn_category_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return encode.top_n_encode(part, part, ["p_type", "p_brand"], 5)


def topn_hash_encode(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return encode.top_n_encode(part, part, ["p_type", "p_brand"], 5, buckets=16, key="gneiss")


def label_encode(spark, d):
    li = lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag")
    return encode.label_encode(li, li, "l_returnflag", "encoded_l_returnflag")


def capped_category(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return encode.capped_category(part, part, ["p_brand"], 10)


def one_hot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot(o, o, "o_orderstatus")


def l2_normalised(spark, d):
    x = encode.l2_normalise(F.col("x"))
    return rounded(emb(spark, d).select("id", F.posexplode(x).alias("f", "v")))


def table_profile(spark, d):
    return profile.table_profile(_dirty_events(spark, d).select("event_type", "value", "event_id")).select("column", "n_rows", "n_missing", "n_distinct")


def class_weights(spark, d):
    return rounded(profile.class_weights(table(spark, d, "lineitem"), "l_returnflag"))


def cluster_distribution(spark, d):
    out = profile.cluster_distribution(emb(spark, d), "class", "cluster")
    return rounded(out.withColumn("clusters", F.array_join("clusters", ",")))


def stratified_split(spark, d):
    return split.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


def stratified_folds(spark, d):
    return split.stratified_folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5)


def undersample_to_min(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.undersample(o, "o_orderstatus", "o_orderkey")


def subsample_rows(spark, d):
    return split.subsample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 100, "c_custkey")


def subsample_strata(spark, d):
    return split.subsample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 100, "c_custkey", "c_mktsegment")


def cluster_subsample(spark, d):
    return split.cluster_subsample(emb(spark, d).select("id", "cluster"), "cluster", "id", 200, 3)


def proportional_cap(spark, d):
    return split.proportional_cap(emb(spark, d).select("id", "cluster"), "cluster", "id", 120)


def topk_per_group(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    per = li.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("revenue"))
    ranked = per.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", "revenue")
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("revenue"), "p_partkey")
    return ranked.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").withColumn("revenue", F.round("revenue", 2))


def left_join_features(spark, d):
    feats = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_size").alias("mean_size"), F.max("p_retailprice").alias("cluster_class"))
    part = table(spark, d, "part").select("p_partkey", "p_brand", F.lit(0.0).alias("MEAN_SIZE"))
    return rounded(joins.attach_features(part, feats.filter("p_brand <> 'Brand#11'"), "p_brand"))


def lookup_rates(spark, d):
    rates = table(spark, d, "orders").filter("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("rate"))
    return rounded(joins.lookup_rate(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), rates, "o_custkey"), 2)


def semi_join_keep(spark, d):
    ids = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_ids(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


def anti_join_noise(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return joins.drop_ids(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ids, "c_custkey")


def union_splits(spark, d):
    li = lines(spark, d).select("l_returnflag", "split")
    parts = [li.filter(F.col("split") == s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"))


def distinct_ids(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return a.union(o.filter("o_orderstatus = 'F'").select("o_orderkey")).distinct().subtract(o.filter("o_totalprice < 100000").select("o_orderkey"))


def classifier_columns(spark, d):
    """The columns of orders as linear discriminants take them: numbers as they are, categories one by one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return prepare.classifier_preprocessor("lda", ["o_totalprice"], ["o_orderstatus"]).apply(orders, orders)


def column_preprocessor(spark, d):
    li = lines(spark, d).select("l_orderkey", "l_linenumber", "split", "l_tax", "l_returnflag")
    both = prepare.ColumnPreprocessor(["l_tax"], ["l_returnflag"], "log_robust", "top_n", {"top_n": 2})
    return rounded(both.apply(li, li.filter("split = 'train'")))


def drop_all_missing(spark, d):
    i, v = F.col("event_id"), F.col("value")
    events = table(spark, d, "events").select("event_id", F.when(i % 2 == 0, v).alias("a"), F.when(i % 3 == 0, float("nan")).otherwise(F.when(i % 5 == 0, v)).alias("b"))
    return prepare.drop_all_missing(events, ["a", "b"]).select("event_id")


def label_names(spark, d):
    return prepare.label_names(table(spark, d, "lineitem"), "l_returnflag")


def extended_dataset(spark, d):
    """Rows with their cluster's size and mean first coordinate, scaled as the train rows have it; clusters ending in 3 have none."""
    points = emb(spark, d).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("size"), F.avg(F.get("x", F.lit(0))).alias("first")).filter("cluster % 10 <> 3")
    return rounded(prepare.extended_splits(points.select("id", "cluster", "split"), sizes))


def extended_dataset_labelfree(spark, d):
    """As extended_dataset, with every row in the cluster of the nearest centroid."""
    points = emb(spark, d).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("size"))
    return rounded(prepare.extended_splits(points.select("id", "cluster", "split", "x"), sizes, cents=geometry.centroids(points, "cluster")))


def failing_clusters(spark, d):
    return rounded(prepare.cluster_counts(metrics.cluster_errors(pred(spark, d).filter("id % 3 = 0"))))


_NAMES = """drop_nonfinite predicate_filter rare_category_filter small_cluster_absorb log_robust_scale median_impute_scale
topn_category_encode topn_hash_encode label_encode capped_category one_hot l2_normalised table_profile class_weights
cluster_distribution stratified_split stratified_folds undersample_to_min subsample_rows subsample_strata cluster_subsample
proportional_cap topk_per_group left_join_features lookup_rates semi_join_keep anti_join_noise union_splits distinct_ids
classifier_columns column_preprocessor drop_all_missing label_names extended_dataset extended_dataset_labelfree failing_clusters""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_EV = """ev AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events)"""
_SCALE = ", ".join(f"quantile_cont(ln(1 + greatest({c}, 0) + 1e-10), [0.25, 0.5, 0.75]) AS q_{c}" for c in NUM)
_KEY = "md5('42:' || CAST({} AS VARCHAR))"
_RANK = "row_number() OVER (PARTITION BY {} ORDER BY md5('42:' || CAST({} AS VARCHAR)), {})"


def _top(c: str, n: int) -> str:
    ranked = f"SELECT {c}, row_number() OVER (ORDER BY n DESC, {c}) AS code FROM (SELECT {c}, count(*) AS n FROM part GROUP BY {c})"
    return f"(SELECT * FROM ({ranked}) WHERE code <= {n})"


def _scaled(c: str) -> str:
    spread = f"CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END"
    return r6(f"(ln(1 + greatest({c}, 0) + 1e-10) - q_{c}[2]) / ({spread})") + f" AS {c}"


ORACLE = {
    "drop_nonfinite": f"WITH {_EV} SELECT * FROM ev WHERE value IS NOT NULL",
    "predicate_filter": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
        WHERE l_returnflag = 'R' AND l_quantity IN (1, 2, 3) AND NOT (l_linestatus = 'O' OR l_discount > 0.05)""",
    "rare_category_filter": """WITH m AS (SELECT (count(*) // 25) // 2 + 1 AS n FROM part),
        a AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN
              (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) >= (SELECT n FROM m)))
        SELECT * FROM a WHERE p_size IN (SELECT p_size FROM a GROUP BY p_size HAVING count(*) >= (SELECT n FROM m))""",
    "small_cluster_absorb": f"""WITH {EMB} SELECT id, CASE WHEN count(*) OVER (PARTITION BY cluster) < 12 THEN -1 ELSE cluster END AS cluster FROM emb""",
    "log_robust_scale": f"""WITH {LINES}, q AS (SELECT {_SCALE} FROM li WHERE split = 'train')
        SELECT l_orderkey, l_linenumber, split, """
    + ", ".join(map(_scaled, NUM))
    + " FROM li, q",
    "median_impute_scale": f"""WITH {LINES}, b AS (SELECT l_orderkey, l_linenumber, split, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END AS l_tax, l_quantity FROM li),
        m AS (SELECT quantile_cont(l_tax, 0.5) AS mt, quantile_cont(l_quantity, 0.5) AS mq FROM b WHERE split = 'train'),
        f AS (SELECT l_orderkey, l_linenumber, split, coalesce(l_tax, mt) AS l_tax, coalesce(l_quantity, mq) AS l_quantity FROM b, m),
        q AS (SELECT quantile_cont(l_tax, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS b FROM f WHERE split = 'train')
        SELECT l_orderkey, l_linenumber, {r6("(l_tax - a[2]) / (a[3] - a[1])")} AS l_tax, {r6("(l_quantity - b[2]) / (b[3] - b[1])")} AS l_quantity FROM f, q""",
    "topn_category_encode": f"""SELECT p_partkey, CAST(coalesce(t.code, 0) AS INTEGER) AS p_type, CAST(coalesce(b.code, 0) AS INTEGER) AS p_brand
        FROM part LEFT JOIN {_top("p_type", 5)} t ON t.p_type = part.p_type LEFT JOIN {_top("p_brand", 5)} b ON b.p_brand = part.p_brand""",
    "label_encode": """SELECT l_orderkey, l_linenumber, l_returnflag, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS encoded_l_returnflag FROM lineitem""",
    "capped_category": f"SELECT p_partkey, t.p_brand FROM part LEFT JOIN {_top('p_brand', 10)} t ON t.p_brand = part.p_brand",
    "one_hot": """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus=F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus=O",
        CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus=P" FROM orders""",
    "l2_normalised": f"""WITH {EMB} SELECT id, CAST(f - 1 AS INTEGER) AS f, {r6("x[f] / greatest(sqrt(list_dot_product(x, x)), 1e-8)")} AS v FROM emb, range(1, 65) AS r(f)""",
    "table_profile": f"WITH {_EV} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_distinct FROM ev"
        for c in ("event_type", "value", "event_id")
    ),
    "class_weights": f"""WITH s AS (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1),
        w AS (SELECT class, n, ln(1 + sum(n) OVER () / (count(*) OVER () * n)) AS w FROM s)
        SELECT class, n, {r6("w / max(w) OVER ()")} AS weight FROM w""",
    "cluster_distribution": f"""WITH {EMB}, s AS (SELECT class, cluster, count(*) AS n, sum(count(*)) OVER (PARTITION BY class) AS t FROM emb GROUP BY class, cluster)
        SELECT class, string_agg(CAST(cluster AS VARCHAR), ',' ORDER BY cluster) AS clusters, CAST(sum(n) AS BIGINT) AS n_rows,
          {r6("CASE WHEN count(*) > 1 THEN sum(-(n / t) * ln(n / t)) / ln(count(*)) ELSE 0 END")} AS balance FROM s GROUP BY class""",
    "stratified_split": f"""WITH r AS (SELECT o_orderkey, o_orderpriority, {_RANK.format("o_orderpriority", "o_orderkey", "o_orderkey")} AS rk,
          count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
        c AS (SELECT *, floor(n * 0.8 + 0.5) AS a FROM r)
        SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= a THEN 'train' WHEN rk <= a + floor((n - a) * 0.5 + 0.5) THEN 'val' ELSE 'test' END AS split FROM c""",
    "stratified_folds": f"SELECT o_orderkey, o_orderstatus, CAST(({_RANK.format('o_orderstatus', 'o_orderkey', 'o_orderkey')} - 1) % 5 AS INTEGER) AS fold FROM orders",
    "undersample_to_min": f"""SELECT o_orderkey, o_orderstatus FROM orders
        QUALIFY {_RANK.format("o_orderstatus", "o_orderkey", "o_orderkey")} <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))""",
    "subsample_rows": f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY {_KEY.format('c_custkey')}, c_custkey LIMIT 100",
    "subsample_strata": f"""SELECT c_custkey, c_mktsegment FROM customer
        QUALIFY {_RANK.format("c_mktsegment", "c_custkey", "c_custkey")} <= 100 // (SELECT count(DISTINCT c_mktsegment) FROM customer)""",
    "proportional_cap": f"""WITH {EMB}, r AS (SELECT id, cluster, {_RANK.format("cluster", "id", "id")} AS rk, count(*) OVER (PARTITION BY cluster) AS n, count(*) OVER () AS t FROM emb)
        SELECT id, cluster FROM r WHERE rk <= greatest(1, floor(n * 120 / t))""",
    "topk_per_group": """WITH r AS (SELECT l_partkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1)
        SELECT p_brand, p_partkey, round(revenue, 2) AS revenue, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS INTEGER) AS rank
        FROM r JOIN part ON l_partkey = p_partkey QUALIFY rank <= 3""",
    "left_join_features": f"""SELECT p_partkey, p_brand, {r6("m.mean_size")} AS mean_size FROM part LEFT JOIN
        (SELECT p_brand, avg(p_size) AS mean_size FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1) m USING (p_brand)""",
    "lookup_rates": """WITH r AS (SELECT o_custkey, avg(o_totalprice) AS rate FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)
        SELECT c_custkey AS o_custkey, round(coalesce(rate, (SELECT avg(rate) FROM r)), 2) AS rate FROM customer LEFT JOIN r ON c_custkey = r.o_custkey""",
    "semi_join_keep": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "anti_join_noise": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "union_splits": f"WITH {LINES} SELECT l_returnflag, split, count(*) AS n FROM li GROUP BY ALL",
    "distinct_ids": """SELECT DISTINCT k FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)""",
    "cluster_subsample": f"""WITH {EMB}, s AS (SELECT cluster, count(*) AS n, sum(count(*)) OVER () AS total FROM emb GROUP BY cluster),
        a AS (SELECT cluster, total, CAST(least(n, greatest(3, round_even(200 * n / total, 0))) AS BIGINT) AS want FROM s),
        b AS (SELECT *, greatest(want - 3, 0) AS spare, sum(want) OVER () - 200 AS owed FROM a),
        c AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY want DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
        q AS (SELECT cluster, total, want - least(spare, greatest(owed - before, 0)) AS take FROM c)
        SELECT e.id, e.cluster FROM (SELECT id, cluster, {_RANK.format("cluster", "id", "id")} AS rk FROM emb) e JOIN q USING (cluster) WHERE rk <= take OR total <= 200""",
    "classifier_columns": "SELECT o_orderkey, o_totalprice, "
    + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS \"o_orderstatus={v}\"" for v in "FOP")
    + " FROM orders",
    "column_preprocessor": f"""WITH {LINES}, q AS (SELECT quantile_cont(ln(1 + greatest(l_tax, 0) + 1e-10), [0.25, 0.5, 0.75]) AS q_l_tax FROM li WHERE split = 'train'),
        t AS (SELECT l_returnflag, row_number() OVER (ORDER BY n DESC, l_returnflag) AS code FROM (SELECT l_returnflag, count(*) AS n FROM li WHERE split = 'train' GROUP BY 1))
        SELECT l_orderkey, l_linenumber, split, {_scaled("l_tax")}, CAST(CASE WHEN code <= 2 THEN code ELSE 0 END AS INTEGER) AS l_returnflag
        FROM li LEFT JOIN t USING (l_returnflag), q""",
    "drop_all_missing": "SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value) AND (event_id % 2 = 0 OR (event_id % 3 <> 0 AND event_id % 5 = 0))",
    "label_names": "SELECT CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS code, l_returnflag AS name FROM (SELECT DISTINCT l_returnflag FROM lineitem)",
    "extended_dataset": f"""WITH {EMB}, f AS (SELECT cluster, CAST(count(*) AS DOUBLE) AS size, avg(x[1]) AS first FROM emb WHERE cluster % 10 <> 3 GROUP BY cluster),
        r AS (SELECT id, cluster, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split, size, first FROM emb JOIN f USING (cluster)),
        q AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS a, quantile_cont(first, [0.25, 0.5, 0.75]) AS b FROM r WHERE split = 'train')
        SELECT id, cluster, split, {r6("(size - a[2]) / (CASE WHEN a[3] = a[1] THEN 1 ELSE a[3] - a[1] END)")} AS size,
          {r6("(first - b[2]) / (CASE WHEN b[3] = b[1] THEN 1 ELSE b[3] - b[1] END)")} AS first FROM r, q""",
    "extended_dataset_labelfree": f"""WITH {EMB}, {sql_means("cent", "cluster")}, f AS (SELECT cluster, CAST(count(*) AS DOUBLE) AS size FROM emb GROUP BY cluster),
        n AS (SELECT id, arg_min(k.cluster, list_distance(x, k.centroid)) AS cluster FROM emb, cent k GROUP BY id),
        r AS (SELECT id, cluster, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS split, size FROM n JOIN f USING (cluster)),
        q AS (SELECT quantile_cont(size, [0.25, 0.5, 0.75]) AS a FROM r WHERE split = 'train')
        SELECT id, cluster, split, {r6("(size - a[2]) / (CASE WHEN a[3] = a[1] THEN 1 ELSE a[3] - a[1] END)")} AS size FROM r, q""",
    "failing_clusters": f"""WITH {PRED}, e AS (SELECT cluster, avg(CAST(y <> p AS DOUBLE)) AS rate FROM pred WHERE id % 3 = 0 GROUP BY cluster)
        SELECT count(*) AS n_clusters, count(*) FILTER (rate > 0) AS n_failing, {r6("count(*) FILTER (rate > 0) / count(*)")} AS share_failing FROM e""",
}
