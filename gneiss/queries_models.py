"""Queries on clustering, models, resampling and the synthetic table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from gneiss.operators import clean, clustering, models, network, resample, split
from gneiss.plans.scratch import materialize, scratch_dir
from gneiss.plans.views import clu, emb, pred, rounded
from gneiss.sources.synthetic import synthetic_table


def synth_counts(spark, d):
    return synthetic_table(spark).groupBy("label", "true_subgroup").agg(F.count(F.lit(1)).alias("n"))


def synth_cleaned(spark, d):
    t = clean.drop_nonfinite(materialize(synthetic_table(spark)), [f"num_{i}" for i in range(1, 21)])
    return clean.rare_category_filter(t, ["label"], 3000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _clusters(spark, d, algorithm, params):
    labels, _ = clustering.cluster_per_class(emb(spark, d), algorithm, params)
    return labels.select("id", "cluster", "is_noise")


def kmeans_labels(spark, d):
    return _clusters(spark, d, "kmeans", {"n_clusters": [2, 4]})


def gmm_labels(spark, d):
    return _clusters(spark, d, "gmm", {"n_clusters": 2, "ridge": 0.1})


def birch_labels(spark, d):
    return _clusters(spark, d, "birch", {"n_clusters": [2, 4]})


def spectral_labels(spark, d):
    return _clusters(spark, d, "spectral", {"n_clusters": [2, 3], "n_neighbors": 10})


def kprototypes_labels(spark, d):
    e = emb(spark, d)
    cats = F.array((F.col("id") % 2).cast("int"), (F.col("id") % 3).cast("int"))
    labels, _ = clustering.cluster_per_class(e.withColumn("cats", cats), "kprototypes", {"n_clusters": [2, 4]})
    return labels.select("id", "cluster", "is_noise")


def hdbscan_labels(spark, d):
    return _clusters(spark, d, "hdbscan", {"min_cluster_size": [3, 5], "min_samples": [1, 3]})


def _labelled(spark, d):
    return emb(spark, d).select("id", F.col("class").alias("label"), "x")


def _split(spark, d):
    rows = _labelled(spark, d)
    return rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")


def tree_predictions(spark, d):
    return models.fit_predict("decision_tree", {"max_depth": 10}, *_split(spark, d)).select("id", "y", "p")


def forest_out_of_fold(spark, d):
    return models.out_of_fold("random_forest", {"n_estimators": 20, "max_depth": 6}, _labelled(spark, d), 3).select("id", "y", "p", "fold")


def logistic_predictions(spark, d):
    return models.fit_predict("logistic_regression", {"max_iter": 50}, *_split(spark, d)).select("id", "y", "p")


def naive_bayes_predictions(spark, d):
    return models.fit_predict("naive_bayes", {}, *_split(spark, d)).select("id", "y", "p")


def lda_predictions(spark, d):
    return models.lda_predict(*_split(spark, d)).select("id", "y", "p")


def knn_predictions(spark, d):
    return models.knn_predict(*_split(spark, d), k=5)


def mlp_predictions(spark, d):
    return models.fit_predict("mlp", {"max_iter": 30}, *_split(spark, d)).select("id", "y", "p")


def _network(spark, d):
    rows = _labelled(spark, d).withColumn("cats", F.array((F.col("id") % 3).cast("int")))
    train, test = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")
    settings = network.Settings(loss="focal", label_smoothing=0.05, epochs=30)
    return network.network_predict(network.fit_network(train.filter("id % 5 <> 1"), train.filter("id % 5 = 1"), settings)[0], test)


def network_predictions(spark, d):
    return _network(spark, d).select("id", "y", "p")


def network_embeddings(spark, d):
    return rounded(_network(spark, d).select("id", F.posexplode("z").alias("f", "v")))


def boosted_predictions(spark, d):
    return models.fit_predict("hist_gradient_boosting", {"max_iter": 5, "max_depth": 3}, *_split(spark, d)).select("id", "y", "p")


def _failures(spark, d):
    rows = clu(spark, d).select("cluster", "rate", "support", "score")
    return models.nested_failure_regression(rows, ["support", "score"], "rate", [{"n_estimators": 20, "max_depth": 3}, {"n_estimators": 20, "max_depth": 5}], outer=3, inner=2)


def failure_regression(spark, d):
    return _failures(spark, d)[0].select("cluster", "fold", "actual", "predicted")


def failure_importances(spark, d):
    return rounded(_failures(spark, d)[1].groupBy("name").agg(F.avg("importance").alias("importance")))


def saved_model_predictions(spark, d):
    train, test = _split(spark, d)
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save_model(models.fit("decision_tree", {"max_depth": 10}, train), path)
    return models.predict(models.load_model(path), test).select("id", "y", "p")


def linear_svc_predictions(spark, d):
    return models.calibrated_predict("linear_svc", {"C": 1.0, "max_iter": 10}, *_split(spark, d)).select("id", "y", "p")


def svm_rbf_predictions(spark, d):
    return models.svm_rbf_predict(*_split(spark, d), n=128, max_iter=10).select("id", "y", "p")


def attributions(spark, d):
    """Attributions of the first class's probability under a fitted discriminant to the coordinates, for all rows."""
    rows = _labelled(spark, d)
    w, b = models.fit_lda(rows)

    def first(x: np.ndarray) -> np.ndarray:
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e[:, 0] / e.sum(axis=1)

    # the background: centres of a draw from all rows
    drawn = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(2000).collect()])
    label = clustering.kmeans(drawn, n_clusters=25)
    background = np.array([drawn[label == c].mean(axis=0) for c in np.unique(label)])
    out = models.shapley_values(first, background, rows)
    return rounded(out.select("id", F.posexplode("values").alias("f", "value")))


def _bootstrap_inputs(spark, d):
    # one row per cluster
    c = clu(spark, d).orderBy("cluster").toPandas()
    rng = np.random.default_rng(0)
    return {"score": c["score"].to_numpy(), "random": rng.random(len(c))}, c["rate"].to_numpy(), c["support"].to_numpy(float), c["cluster"].to_numpy() // 10


def bootstrap_ci(spark, d):
    scores, rate, support, _ = _bootstrap_inputs(spark, d)
    return rounded(resample.intervals(resample.bootstrap_draws(spark, scores, rate, support, n=400), "score"))


def block_bootstrap(spark, d):
    """Instances are resampled by whole clusters; at most 50,000 of them are drawn by hash, as in the capped sample of a run."""
    p = split.subsample(pred(spark, d), 50_000, "id").select("id", "cluster", F.array_max("proba").alias("top"), (F.col("y") != F.col("p")).cast("double").alias("failure"))
    p = p.orderBy("id").toPandas()
    region = p.groupby("cluster")["failure"].transform("mean").to_numpy()
    scores = {"region": region, "mcp": 1 - p["top"].to_numpy(), "random": np.random.default_rng(0).random(len(p))}
    return rounded(resample.adaptive_block_bootstrap(spark, scores, p["failure"].to_numpy(), p["cluster"].to_numpy(), reference="mcp", n=400, batch=200))


_NAMES = """synth_counts synth_cleaned kmeans_labels gmm_labels birch_labels spectral_labels kprototypes_labels hdbscan_labels tree_predictions forest_out_of_fold
logistic_predictions naive_bayes_predictions lda_predictions knn_predictions mlp_predictions network_predictions network_embeddings saved_model_predictions linear_svc_predictions svm_rbf_predictions boosted_predictions failure_regression failure_importances
attributions bootstrap_ci block_bootstrap""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LAB = "emb AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
ORACLE = {
    "naive_bayes_predictions": f"""WITH {_LAB}, f AS (SELECT id, label, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS f FROM emb),
        t AS (SELECT * FROM f WHERE id % 5 <> 0), e AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(v) AS v FROM t GROUP BY f)),
        m AS (SELECT label, f, avg(v) AS mu, var_pop(v) + any_value(eps) AS var FROM t, e GROUP BY label, f),
        c AS (SELECT label, ln(count(*)) AS prior FROM emb WHERE id % 5 <> 0 GROUP BY label),
        s AS (SELECT f.id, any_value(f.label) AS y, m.label AS p, any_value(prior) - sum(ln(var) / 2 + (v - mu) * (v - mu) / (2 * var)) AS score
              FROM f JOIN m USING (f) JOIN c ON c.label = m.label WHERE f.id % 5 = 0 GROUP BY f.id, m.label)
        SELECT id, any_value(y) AS y, arg_max(p, score) AS p FROM s GROUP BY id""",
    "knn_predictions": f"""WITH {_LAB}, n AS (SELECT t.id, t.label AS y, r.label AS v FROM emb t JOIN emb r ON t.id % 5 = 0 AND r.id % 5 <> 0
          QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.x, r.x), r.id) <= 5),
        c AS (SELECT id, y, v, count(*) AS w FROM n GROUP BY ALL)
        SELECT id, y, v AS p FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, v) = 1""",
}
