"""Classifiers and regressors on top of pyspark.ml, out-of-fold prediction, nested validation and attributions.

Every classifier returns rows with ``prediction`` and an array of class probabilities, so that
all later operators see one shape.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.operators import curves, geometry, split
from gneiss.plans.order import random_ranks
from gneiss.plans.scratch import materialize

def _own(given: dict, **known):
    """The parameters of a configuration over their defaults; a name that is not known raises."""
    if unknown := given.keys() - known.keys() - IGNORED:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return SimpleNamespace(**(known | {k: v for k, v in given.items() if k in known}))


#: Parameters without a counterpart: they change where or how fast a model is fitted, not which.
IGNORED = {"n_jobs", "eval_metric", "solver", "verbose", "probability"}
#: The deepest tree that pyspark.ml grows; a depth of None means this.
DEEPEST = 30


def _decision_tree(n: int, **given):
    p = _own(given, max_depth=None, min_samples_leaf=1, seed=42)
    return C.DecisionTreeClassifier(maxDepth=p.max_depth or DEEPEST, minInstancesPerNode=p.min_samples_leaf, seed=p.seed)


def _random_forest(n: int, **given):
    p = _own(given, n_estimators=200, max_depth=None, min_samples_leaf=1, seed=42)
    return C.RandomForestClassifier(numTrees=p.n_estimators, maxDepth=p.max_depth or DEEPEST, minInstancesPerNode=p.min_samples_leaf, seed=p.seed)


def _boosted(n: int, **given):
    """One boosted forest per class; both histogram boosters of the configuration map to it."""
    p = _own(given, max_iter=200, n_estimators=None, learning_rate=0.1, max_depth=None, seed=42)
    return C.OneVsRest(classifier=C.GBTClassifier(maxIter=p.n_estimators or p.max_iter, stepSize=p.learning_rate, maxDepth=p.max_depth or 6, seed=p.seed), parallelism=8)


def _logistic(n: int, **given):
    """C weighs the summed loss against half the squared weights, so the penalty on the mean loss is 1 / (C n)."""
    p = _own(given, C=1.0, max_iter=1000)
    return C.LogisticRegression(maxIter=p.max_iter, regParam=1.0 / (p.C * n), standardization=False, family="multinomial")


def _linear_svc(n: int, **given):
    p = _own(given, C=1.0, max_iter=2000)
    return C.OneVsRest(classifier=C.LinearSVC(maxIter=p.max_iter, regParam=1.0 / (p.C * n), standardization=False), parallelism=8)


def _naive_bayes(n: int, **given):
    if _own(given, var_smoothing=1e-9).var_smoothing != 1e-9:
        raise ValueError("var_smoothing is fixed at 1e-9")
    return C.NaiveBayes(modelType="gaussian")


def _mlp(n: int, **given):
    p = _own(given, layers=(64, 32, 10), max_iter=100, seed=42)
    return C.MultilayerPerceptronClassifier(layers=list(p.layers), maxIter=p.max_iter, seed=p.seed)


#: Estimator makers by name: the number of train rows and a configuration's parameters.
REGISTRY: dict[str, Callable] = {
    "decision_tree": _decision_tree,
    "random_forest": _random_forest,
    "hist_gradient_boosting": _boosted,
    "xgboost": _boosted,
    "logistic_regression": _logistic,
    "naive_bayes": _naive_bayes,
    "linear_svc": _linear_svc,
    "mlp": _mlp,
}


def features(df: DataFrame) -> DataFrame:
    """id, x and label to what estimators expect."""
    return df.withColumn("features", array_to_vector("x")).withColumn("label", F.col("label").cast("double"))


def _proba(df: DataFrame) -> DataFrame:
    """``proba``: the probability column, else the softmax of the raw scores."""
    if "probability" in df.columns:
        return df.withColumn("proba", vector_to_array("probability"))
    raw = vector_to_array("rawPrediction")
    e = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
    return df.withColumn("proba", F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)))


def fit(name: str, params: dict, train: DataFrame) -> PipelineModel:
    """The named model on ``train``: id, label (0..k-1), x."""
    return Pipeline(stages=[REGISTRY[name](train.count(), **params)]).fit(features(train))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """id, y, p, proba."""
    out = _proba(model.transform(features(rows)))
    return out.select("id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"), "proba")


def fit_predict(name: str, params: dict, train: DataFrame, test: DataFrame) -> DataFrame:
    """id, y, p, proba of the test rows."""
    return predict(fit(name, params, train), test)


def save_model(model: PipelineModel, path: str) -> None:
    """Write a fitted model to a folder that all executors share; an earlier one there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrated_predict(name: str, params: dict, train: DataFrame, test: DataFrame, *, k: int = 3, seed: int = 42) -> DataFrame:
    """id, y, p, proba by a one-vs-rest model whose scores are turned into probabilities.

    Per class a logistic curve is fitted from the out-of-fold scores of the train rows to whether a row is of the class; the curves'
    values on the test rows are divided by their sum, and the largest wins, ties to the smaller class. Classes are 0..n-1.
    """
    folds = materialize(split.stratified_folds(train, "label", "id", k, seed))
    scores = None
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        part = fit(name, params, folds.filter(F.col("fold") != f)).transform(features(folds.filter(F.col("fold") == f)))
        part = part.select("label", vector_to_array("rawPrediction").alias("raw"))
        scores = part if scores is None else scores.unionByName(part)
    scores = materialize(scores)
    held = fit(name, params, train).transform(features(test)).select("id", F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction").alias("raw"))
    # all classes' curves in one fit: a slope and an offset each
    n = scores.agg(F.max(F.size("raw"))).first()[0]

    def at_class(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("c"), v).otherwise(0.0))

    long = scores.select("label", F.posexplode("raw").alias("c", "score")).select(
        (F.col("label") == F.col("c")).cast("double").alias("label"),
        array_to_vector(F.concat(at_class(F.col("score")), at_class(F.lit(1.0)))).alias("features"),
    )
    line = C.LogisticRegression(family="binomial", maxIter=100, regParam=1e-4, fitIntercept=False).fit(long).coefficients.toArray().tolist()
    curves = [1 / (1 + F.exp(-(F.lit(line[c]) * F.get("raw", F.lit(c)) + line[n + c]))) for c in range(n)]
    out = held.select("id", "y", F.array(*curves).alias("raw"))
    total = F.greatest(F.aggregate("raw", F.lit(0.0), lambda s, v: s + v), F.lit(1e-300))
    out = out.select("id", "y", F.transform("raw", lambda v: v / total).alias("proba"))
    return out.select("id", "y", (F.array_position("proba", F.array_max("proba")) - 1).cast("int").alias("p"), "proba")


def kernel_features(rows: DataFrame, train: DataFrame, *, gamma: float | str = "scale", n: int = 512, seed: int = 42) -> DataFrame:
    """``x`` replaced by ``n`` random Fourier features, whose dot products approach the radial kernel exp(-gamma |a - b|^2).

    gamma "scale" is 1 / (columns * variance of all train values). The error falls with the square root of ``n``.
    """
    d = len(train.select("x").first()[0])
    if gamma == "scale":
        gamma = 1 / (d * (train.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0))

    def mapped(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        w, b = rng.standard_normal((d, n)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, n)
        for pdf in it:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)
            yield pdf.assign(x=list(np.cos(x @ w + b) * np.sqrt(2 / n)))

    return rows.select("id", "label", "x").mapInPandas(mapped, "id bigint, label int, x array<double>")


def svm_rbf_predict(train: DataFrame, test: DataFrame, *, C: float = 1.0, gamma: float | str = "scale", n: int = 512, max_iter: int = 100) -> DataFrame:
    """id, y, p, proba of a calibrated support vector machine with a radial kernel, by random Fourier features."""
    sides = [materialize(kernel_features(df, train, gamma=gamma, n=n)) for df in (train, test)]
    return calibrated_predict("linear_svc", {"C": C, "max_iter": max_iter}, *sides)


def fit_lda(train: DataFrame, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) of the linear discriminant; class sums and one pooled scatter are summed per partition."""

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for c, rows in pdf.groupby("label"):
                x = np.array(rows["x"].tolist(), float)
                yield pd.DataFrame({"label": [int(c)], "n": [len(x)], "s": [x.sum(0)], "m": [(x.T @ x).ravel()]})

    parts = train.select("label", "x").mapInPandas(sums, "label int, n bigint, s array<double>, m array<double>")
    # d x d numbers per class
    flat = parts.select("label", "n", F.posexplode(F.concat("s", "m")).alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v"))
    sizes = {r["label"]: r["n"] for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    vec: dict[int, dict[int, float]] = {}
    for r in flat.collect():
        vec.setdefault(r["label"], {})[r["i"]] = r["v"]
    labels = sorted(sizes)
    total = sum(sizes.values())
    pooled, means = 0.0, []
    for c in labels:
        v = np.array([vec[c][i] for i in range(len(vec[c]))])
        d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        mean = v[:d] / sizes[c]
        means.append(mean)
        pooled = pooled + v[d:].reshape(d, d) - sizes[c] * np.outer(mean, mean)
    mean = np.array(means)
    cov = pooled / max(total - len(labels), 1) + ridge * np.eye(mean.shape[1])
    w = np.linalg.solve(cov, mean.T)
    return w, -0.5 * np.einsum("ij,ji->i", mean, w) + np.log(np.array([sizes[c] for c in labels]) / total)


def lda_predict(train: DataFrame, test: DataFrame) -> DataFrame:
    """id, y, p, proba by the linear discriminant; labels are 0..k-1."""
    sent = train.sparkSession.sparkContext.broadcast(fit_lda(train))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b = sent.value
        for pdf in it:
            z = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1) @ w + b
            e = np.exp(z - z.max(1, keepdims=True))
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["label"].astype(int), "p": z.argmax(1), "proba": list(e / e.sum(1, keepdims=True))})

    return test.select("id", "label", "x").mapInPandas(batches, "id bigint, y int, p int, proba array<double>")


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform") -> DataFrame:
    """id, y, p: vote of the k nearest train rows (uniform or by inverse distance), ties to the smaller label.

    Test and train rows meet in pairs of blocks, and the best of all blocks vote.
    """

    def nearest(q: pa.Table, b: pa.Table) -> pa.Table:
        mine, ids = q.column("id").to_numpy(), b.column("id").to_numpy()
        row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(mine) and len(ids):
            x, base = geometry.rows_matrix(q, "x"), geometry.rows_matrix(b, "x")
            for lo in range(0, len(mine), geometry.QUERY_ROWS):
                d = geometry.distances(x[lo : lo + geometry.QUERY_ROWS], base, "euclidean")
                r, c = geometry.nearest_rows(d, ids, k)
                row, col, dist = np.r_[row, lo + r], np.r_[col, c], np.r_[dist, d[r, c]]
        y, label = q.column("label").to_numpy(), b.column("label").to_numpy()
        return pa.table({"id": mine[row], "y": y[row], "vote": label[col], "from": ids[col], "d": dist})

    sides = [df.select("id", F.col("label").cast("int").alias("label"), "x") for df in (test, train)]
    found = geometry.block_pairs(*sides, nearest, "id bigint, y int, vote int, from bigint, d double")
    best = found.groupBy("id", "y").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "from", "vote"))), 1, k).alias("n"))
    each = best.select("id", "y", F.explode("n").alias("n"))
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("n.d"), F.lit(1e-12))
    votes = each.groupBy("id", "y", F.col("n.vote").alias("vote")).agg(F.sum(w).alias("w"))
    return votes.groupBy("id", "y").agg(F.max_by("vote", F.struct("w", -F.col("vote"))).alias("p"))


def out_of_fold(name: str, params: dict, df: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Predictions of every row by a model that has not seen its fold. ``df``: id, label, x."""
    folds = materialize(split.stratified_folds(df, "label", "id", k, seed))
    out = None
    for f in sorted(r[0] for r in folds.select("fold").distinct().collect()):
        part = fit_predict(name, params, folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)).withColumn("fold", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out


def grid_search(name: str, fixed: dict, grid: dict[str, list], df: DataFrame, *, folds: int = 3, max_samples: int = 50_000, parallelism: int = 4, seed: int = 42) -> tuple[dict, float]:
    """(best parameters, macro-like F1) by cross-validation on a stratified sample; combinations are fitted side by side."""
    n, classes = df.count(), df.select("label").distinct().count()
    sample = df if n <= max_samples else split.sample_per_group(df, ["label"], max_samples // classes, "id", seed)
    sample = features(materialize(sample))
    rows, best = max(1, sample.count() * (folds - 1) // folds), None
    for values in itertools.product(*grid.values()):
        params = fixed | dict(zip(grid, values))
        est = REGISTRY[name](rows, **params)
        cv = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, parallelism=parallelism, seed=seed)
        score = cv.fit(sample).avgMetrics[0]
        if best is None or score > best[1]:
            best = params, score
    return best


def outer_folds(rows: DataFrame, target: str, k: int, *, strata: int = 5, key: str = "cluster", seed: int = 42) -> DataFrame:
    """``fold`` added: folds that spread every quantile bin of the target evenly; plain random folds where the bins are too few or too small."""
    binned = materialize(curves.quantile_bins(rows, target, strata))
    sizes = [r["n"] for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()]
    by = ["bin"] if len(sizes) > 1 and min(sizes) >= k else []
    order = random_ranks(binned, [F.col(c) for c in by] or [F.lit(0)], split.order_key(key, seed), F.col(key))
    return order.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "bin")


def nested_failure_regression(rows: DataFrame, cols: list[str], target: str, grid: list[dict], *, outer: int = 5, inner: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((cluster, fold, actual, predicted, params), (fold, name, importance)): random forests, their parameters chosen by inner folds' mean R2.

    Cluster tables are small (at most the cluster budget), so missing values are imputed with the outer fold's train
    medians plus a missing flag, and folds x combinations are the unit of work. ``rows``: cluster, target, cols. An inner fold without spread
    doesn't count; with fewer than ``inner`` rows the first combination is taken.
    """
    folds = materialize(outer_folds(rows, target, outer, seed=seed).withColumn("_inner", F.pmod(F.xxhash64("cluster", F.lit(seed)), F.lit(inner)).cast("int")))
    out, weights = None, []
    names = [*cols, *(f"{c}_missing" for c in cols)]
    score = RegressionEvaluator(metricName="r2")
    for f in range(outer):
        train, test = folds.filter(F.col("fold") != f), folds.filter(F.col("fold") == f)
        medians = train.agg(*[F.median(c).alias(c) for c in cols]).first().asDict()

        def ready(df: DataFrame, medians=medians) -> DataFrame:
            flat = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(medians[c] or 0.0)) for c in cols]
            flags = [F.col(c).isNull().cast("double") for c in cols]
            return df.select("cluster", "fold", "_inner", F.col(target).cast("double").alias("label"), array_to_vector(F.array(*flat, *flags)).alias("features"))

        tr = ready(train).coalesce(1).cache()
        parts = [(tr.filter(F.col("_inner") != i), tr.filter(F.col("_inner") == i)) for i in range(inner)]
        parts = [(a, b) for a, b in parts if len({r[0] for r in b.select("label").limit(50).collect()}) > 1 and not a.isEmpty()]
        best = None
        for g in grid:
            est = R.RandomForestRegressor(numTrees=g.get("n_estimators", 100), maxDepth=g.get("max_depth") or DEEPEST, minInstancesPerNode=g.get("min_samples_leaf", 1), seed=seed)
            mean = float(np.mean([score.evaluate(est.fit(a).transform(b)) for a, b in parts])) if parts and len(grid) > 1 else 0.0
            if best is None or mean > best[0]:
                best = mean, g, est
        model = best[2].fit(tr)
        weights += [(f, n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
        part = model.transform(ready(test)).select("cluster", "fold", F.col("label").alias("actual"), F.col("prediction").alias("predicted"), F.lit(str(sorted(best[1].items()))).alias("params"))
        part = materialize(part)
        tr.unpersist()
        out = part if out is None else out.unionByName(part)
    return out, rows.sparkSession.createDataFrame(weights, "fold int, name string, importance double")


def shapley_values(predict: Callable[[np.ndarray], np.ndarray], background: np.ndarray, samples: DataFrame, *, n_coalitions: int = 200, seed: int = 0) -> DataFrame:
    """id, values: kernel-weighted linear attributions per feature for the first output of ``predict``.

    Samples are mapped batch by batch; ``background`` is a bounded summary. Attributions and the base value add up to the prediction.
    """
    sent = samples.sparkSession.sparkContext.broadcast(background)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = sent.value
        d = base.shape[1]
        rng = np.random.default_rng(seed)
        sizes = np.arange(1, d)
        share = (d - 1) / (sizes * (d - sizes))
        masks = np.zeros((n_coalitions, d), bool)
        for m in masks:
            m[rng.choice(d, rng.choice(sizes, p=share / share.sum()), replace=False)] = True
        mean = float(predict(base).mean())
        for pdf in it:
            out = []
            for x in pdf["x"]:
                x = np.asarray(x, float)
                full = float(predict(x[None])[0])
                mixed = np.where(masks[:, None, :], x, base[None])
                y = predict(mixed.reshape(-1, d)).reshape(len(masks), -1).mean(axis=1) - mean
                # the constraint that attributions sum to the difference removes the last feature
                z = masks[:, :-1].astype(float) - masks[:, -1:]
                head = np.linalg.lstsq(z, y - masks[:, -1] * (full - mean), rcond=None)[0]
                out.append(np.r_[head, full - mean - head.sum()])
            yield pd.DataFrame({"id": pdf["id"], "values": out})

    return samples.select("id", "x").mapInPandas(batches, "id bigint, values array<double>")


def focal_loss(proba: np.ndarray, y: np.ndarray, gamma: float = 2.0, smoothing: float = 0.0, ignore: int = -1) -> float:
    """Mean focal cross-entropy with label smoothing over rows whose label isn't ``ignore``; gamma 0 is plain cross-entropy."""
    keep = y != ignore
    p = np.clip(proba[keep], 1e-12, 1)
    k = p.shape[1]
    target = np.full(p.shape, smoothing / k)
    target[np.arange(len(p)), y[keep]] += 1 - smoothing
    return float((-(target * (1 - p) ** gamma * np.log(p)).sum(1)).mean()) if keep.any() else 0.0
