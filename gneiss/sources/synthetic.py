"""A labelled table with known structure: classes of canonical, medium and evasive subgroups.

Rows come from ``spark.range``; every value is a hash-seeded draw of its row, so any partitioning gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per class and shares of the subgroups (canonical, medium, evasive); fixed values.
CLASS_ROWS = {"class_1": 22000, "class_2": 9000, "class_3": 7000, "class_4": 6000, "class_5": 5000, "class_6": 5000, "class_7": 5000, "class_8": 5000, "class_9": 5000, "class_10": 500}
SHARES = {"class_1": (0.8, 0.0, 0.2), "class_8": (0.6, 0.4, 0.0), "class_9": (0.2, 0.4, 0.4)}
USUAL = (0.5, 0.3, 0.2)
#: How far a subgroup's mean lies from its class centre towards the baseline; fixed values.
ALPHA = {"canonical": 0.0, "medium": 0.5, "evasive": 0.8}
N_NUM = 20
BASELINE = 5.0


def class_sizes(total: int | None = None) -> dict[str, int]:
    """Rows per class, in proportion to ``total``; the rare class keeps its 500 rows."""
    if total is None:
        return dict(CLASS_ROWS)
    whole = sum(CLASS_ROWS.values()) - CLASS_ROWS["class_10"]
    return {c: n if c == "class_10" else round(n * (total - CLASS_ROWS["class_10"]) / whole) for c, n in CLASS_ROWS.items()}


def synthetic_table(spark: SparkSession, total: int | None = None, seed: int = 42, n_inf: int = 300, n_nan: int = 200) -> DataFrame:
    """num_1..num_20, cat_1, cat_2, label, true_subgroup, row_id; ``n_inf`` infinite values in num_7 or num_8, ``n_nan`` NaNs in others."""
    sizes = class_sizes(total)
    rows = spark.range(sum(sizes.values())).withColumnRenamed("id", "row_id")
    label, rank, upto = F.lit(None).cast("string"), F.lit(0).cast("bigint"), 0
    share = F.lit(None).cast("array<double>")
    for c, n in sizes.items():
        inside = (F.col("row_id") >= upto) & (F.col("row_id") < upto + n)
        label = F.when(inside, c).otherwise(label)
        rank = F.when(inside, (F.col("row_id") - upto) / n).otherwise(rank)
        share = F.when(inside, F.array(*[F.lit(s) for s in SHARES.get(c, USUAL)])).otherwise(share)
        upto += n
    rows = rows.withColumns({"label": label, "_r": rank, "_s": share})
    group = F.when(F.col("_r") < F.get("_s", F.lit(0)), "canonical").when(F.col("_r") < F.get("_s", F.lit(0)) + F.get("_s", F.lit(1)), "medium").otherwise("evasive")
    rows = rows.withColumn("true_subgroup", group)
    alpha = F.lit(0.0)
    for g, a in ALPHA.items():
        alpha = F.when(F.col("true_subgroup") == g, F.lit(a)).otherwise(alpha)

    def uniform(tag: str):
        return (F.pmod(F.xxhash64("row_id", F.lit(f"{seed}:{tag}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    def normal(tag: str):
        return F.sqrt(-2 * F.ln(uniform(tag + "a"))) * F.cos(2 * 3.141592653589793 * uniform(tag + "b"))

    klass = F.substring_index("label", "_", -1).cast("int")
    nums = {}
    for f in range(1, N_NUM + 1):
        # class centres differ in a few features of each class
        shift = F.when((klass > 1) & (F.pmod(klass * 7 + f, F.lit(5)) == 0), 3.0 + F.pmod(klass, F.lit(3))).otherwise(0.0)
        nums[f"num_{f}"] = BASELINE + (1 - alpha) * shift + normal(f"n{f}")
    rows = rows.withColumns(nums)
    # the rows with the smallest hashes are spoilt: exact numbers, any partitioning
    n = sum(sizes.values())
    step_inf, step_nan = max(n // max(n_inf, 1), 1), max(n // max(n_nan, 1), 1)
    bad_inf = (F.col("row_id") % step_inf == step_inf // 2) & (F.floor(F.col("row_id") / step_inf) < n_inf) & F.lit(n_inf > 0)
    rows = rows.withColumn("num_7", F.when(bad_inf & (F.floor(F.col("row_id") / step_inf) % 2 == 0), F.lit(float("inf"))).otherwise(F.col("num_7")))
    rows = rows.withColumn("num_8", F.when(bad_inf & (F.floor(F.col("row_id") / step_inf) % 2 == 1), F.lit(float("inf"))).otherwise(F.col("num_8")))
    bad_nan = (F.col("row_id") % step_nan == step_nan // 3) & (F.floor(F.col("row_id") / step_nan) < n_nan) & F.lit(n_nan > 0)
    rows = rows.withColumn("num_3", F.when(bad_nan, F.lit(float("nan"))).otherwise(F.col("num_3")))
    pick = uniform("c1")
    cat1 = F.when(pick < 0.5, "A").when(pick < 0.8, "B").otherwise("C")
    pick = uniform("c2")
    cat2 = F.when(F.col("label") == "class_8", "W").when(pick < 0.4, "X").when(pick < 0.7, "Y").otherwise("Z")
    return rows.select("row_id", *[f"num_{f}" for f in range(1, N_NUM + 1)], cat1.alias("cat_1"), cat2.alias("cat_2"), "label", "true_subgroup")
