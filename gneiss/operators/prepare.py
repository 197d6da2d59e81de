"""Whole preparations: columns by type, the columns a classifier takes, splits extended by cluster features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.functions.clean import finite, quoted
from gneiss.operators import encode, geometry, joins

#: How each classifier takes its categories; fixed values.
CLASSIFIER_COLUMNS = {
    "logistic_regression": "onehot",
    "lda": "onehot",
    "svm_rbf": "onehot",
    "linear_svc": "onehot",
    "knn": "onehot",
    "decision_tree": "passthrough",
    "random_forest": "passthrough",
    "hist_gradient_boosting": "native_sklearn",
    "xgboost": "native_xgb",
    "naive_bayes": "drop_cat",
}
#: Most categories of a column that histogram boosting takes; fixed value.
MOST_CATEGORIES = 255

NUMBER_STEPS = {"log_robust": encode.log_robust_scale, "impute_robust": encode.impute_robust_scale}
CATEGORY_STEPS = {
    "top_n": lambda df, train, cols, top_n=100, buckets=0, key="": encode.top_n_encode(df, train, cols, top_n, buckets, key),
    "capped": lambda df, train, cols, cap=MOST_CATEGORIES: encode.capped_category(df, train, cols, cap),
    "onehot": lambda df, train, cols, limit=256: one_hots(df, train, cols, limit),
    "drop": lambda df, train, cols: df.drop(*[quoted(c) for c in cols]),
}


def one_hots(df: DataFrame, train: DataFrame, cols: list[str], limit: int = 256) -> DataFrame:
    for c in cols:
        df = encode.one_hot(df, train, c, limit)
    return df


@dataclass(frozen=True)
class ColumnPreprocessor:
    """A step for the numbers and one for the categories, fitted on the train rows; other columns pass through.

    ``number_step``: log_robust, impute_robust or None; ``category_step``: top_n, capped, onehot, drop or None; ``options`` go to the latter.
    """

    num_cols: list[str]
    cat_cols: list[str]
    number_step: str | None = None
    category_step: str | None = None
    options: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, train: DataFrame) -> DataFrame:
        """``df`` with both steps applied as the train rows have it. Splits are best passed as one table with a split column, so that each step is planned once."""
        out = df
        if self.number_step and self.num_cols:
            out = NUMBER_STEPS[self.number_step](out, train, self.num_cols)
        if self.category_step and self.cat_cols:
            out = CATEGORY_STEPS[self.category_step](out, train, self.cat_cols, **self.options)
        return out


def classifier_preprocessor(name: str, num_cols: list[str], cat_cols: list[str]) -> ColumnPreprocessor:
    """The columns that the named classifier takes; an unknown one takes all as they are."""
    strategy = CLASSIFIER_COLUMNS.get(name, "passthrough")
    step, options = {
        "onehot": ("onehot", {}),
        "drop_cat": ("drop", {}),
        "native_sklearn": ("capped", {"cap": MOST_CATEGORIES}),
        "native_xgb": ("capped", {"cap": 2**31 - 1}),
        "passthrough": (None, {}),
    }[strategy]
    return ColumnPreprocessor(num_cols, cat_cols, None, step, options)


def drop_all_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a finite number in at least one of ``cols``; without ``cols`` all rows."""
    return df.filter(F.coalesce(*[finite(quoted(c)) for c in cols]).isNotNull()) if cols else df


def feature_names(features: DataFrame, exclude: tuple[str, ...] = ("cluster", "cluster_class", "is_noise_cluster")) -> list[str]:
    """The measures of a cluster table that hold a number for some cluster, sorted."""
    names = [c for c, t in features.dtypes if c not in exclude and t in ("double", "float", "int", "bigint")]
    held = features.agg(*[F.count(finite(quoted(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(names)]).first() if names else ()
    return sorted(c for c, n in zip(names, held) if n)


def label_names(train: DataFrame, label: str) -> DataFrame:
    """code, name: the train rows' labels in sorted order, numbered from 0; one row per class."""
    names = train.filter(quoted(label).isNotNull()).select(quoted(label).cast("string").alias("name")).distinct()
    every = names.agg(F.array_sort(F.collect_list("name")).alias("a"))
    return every.select(F.posexplode("a").alias("code", "name"))


def extended_splits(rows: DataFrame, features: DataFrame, *, split: str = "split", cents: DataFrame | None = None, metric: str = "euclidean") -> DataFrame:
    """All splits with the features of their rows' clusters, imputed and scaled as the train rows have it.

    ``rows``: id, cluster, ``split`` and, with ``cents``, x: clusters are then those of the nearest centroid, whatever the label.
    Rows whose cluster has no features are left out.
    """
    if cents is not None:
        near = geometry.nearest_centroid(rows.select("id", "x"), cents, "cluster", metric=metric).select("id", F.col("assigned").alias("cluster"))
        rows = rows.drop("cluster", "x").join(near, "id")
    names = feature_names(features)
    out = drop_all_missing(joins.attach_features(rows, features.select("cluster", *[quoted(c) for c in names]), "cluster"), names)
    return encode.impute_robust_scale(out, out.filter(quoted(split) == "train"), names)


def cluster_counts(errors: DataFrame) -> DataFrame:
    """n_clusters, n_failing, share_failing: clusters with test rows, and those of them with any error. ``errors``: cluster, n_total, failure_rate."""
    tested = errors.filter(F.col("n_total") > 0)
    failing = F.count_distinct(F.when(F.col("failure_rate") > 0, F.col("cluster")))
    return tested.agg(F.count_distinct("cluster").alias("n_clusters"), failing.alias("n_failing")).withColumn(
        "share_failing", F.try_divide("n_failing", "n_clusters")
    )
