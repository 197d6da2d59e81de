import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gneiss.operators import clean, clustering, complexity, curves, encode, geometry, metrics, models, network, resample, split
from gneiss.operators import profile as profiles
from gneiss.operators.joins import attach_features
from gneiss.plans import order

INF, NAN = float("inf"), float("nan")


def _points(spark, n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) + (np.arange(n) % 3)[:, None]
    rows = [(i, i % 3, (i % 3) * 2 + (i // 3) % 2, [float(v) for v in x[i]], [i % 2, i % 5]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, class int, cluster bigint, x array<double>, cats array<int>"), x


def test_drop_nonfinite_and_odd_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "a"), (INF, "a"), (None, "a"), (-INF, None), (2.0, None)], "`a.b c` double, k string")
    assert [r[0] for r in clean.drop_nonfinite(df, ["a.b c"]).collect()] == [1.0, 2.0]
    assert clean.drop_nonfinite(df, ["a.b c", "k"]).count() == 1


def test_predicate_dialect():
    assert clean.predicate_sql("a == 'x == y' and b in [1, 2]") == "a = 'x == y' and b in (1, 2)"
    assert clean.predicate_sql('`c d` == "it\'s"') == "`c d` = 'it''s'"
    with pytest.raises(ValueError):
        clean.predicate_sql("a == @b")


def test_rare_filter_is_sequential_and_keeps_nulls(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "x"), (None, "x"), ("a", "y")], "p string, q string")
    assert sorted(map(tuple, clean.rare_category_filter(df, ["p", "q"], 2).collect()), key=str) == [("a", "x")] * 3 + [(None, "x")]
    assert clean.rare_category_filter(df, ["p"], None) is df


def test_zero_spread_scales_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (NAN, 3.0), (5.0, None)], "a double, b double")
    out = encode.impute_robust_scale(df, df, ["a", "b"]).collect()
    assert [r["a"] for r in out] == [0.0] * 4 and out[3]["b"] == 0.0


def test_top_n_hash_codes(spark):
    train = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "v string")
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",), (None,)], "v string")
    got = [r[0] for r in encode.top_n_encode(df, train, ["v"], 2, buckets=8, key="k").collect()]
    assert sorted(got) == sorted([1, 2, 3 + encode.stable_bucket("k", "v", "c", 8), 3 + encode.stable_bucket("k", "v", "zz", 8), 0])
    assert sorted(r[0] for r in encode.top_n_encode(df, train, ["v"], 2).collect()) == [0, 0, 0, 1, 2]


def test_unknown_label_raises(spark):
    train = spark.createDataFrame([("b",), ("a",)], "y string")
    assert sorted((r["y"], r["e"]) for r in encode.label_encode(train, train, "y", "e").collect()) == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="unknown label"):
        encode.label_encode(spark.createDataFrame([("q",)], "y string"), train, "y", "e").collect()


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    one = {r["id"]: r["split"] for r in split.stratified_split(df, "y", "id").collect()}
    two = {r["id"]: r["split"] for r in split.stratified_split(df.repartition(13), "y", "id").collect()}
    assert one == two
    for y in (0, 1):
        ids = [i for i in range(1000) if (i % 7 == 0) == bool(y)]
        assert sum(one[i] == "train" for i in ids) == math.floor(len(ids) * 0.8 + 0.5)
    with pytest.raises(ValueError):
        split.stratified_split(df, "y", "id", 0.5, 0.1, 0.1)
    with pytest.raises(ValueError):
        split.stratified_folds(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, y string"), "y", "id", 5)


def test_cluster_quotas(spark):
    def quotas(sizes, budget, floor):
        df = spark.createDataFrame(list(sizes.items()), "_c int, _n bigint")
        return {r["_c"]: r["_take"] for r in split.cluster_quotas(df, budget, floor).collect()}

    assert quotas({1: 900, 2: 90, 3: 10}, 100, 5) == {1: 86, 2: 9, 3: 5}
    # many small clusters: the largest gives all it can, the next the rest
    assert quotas({1: 60, 2: 30, 3: 3, 4: 3, 5: 3, 6: 1}, 30, 3) == {1: 11, 2: 9, 3: 3, 4: 3, 5: 3, 6: 1}
    assert quotas({1: 50, 2: 50}, 4, 10) == {1: 10, 2: 10}
    rows = spark.range(1000).select("id", (F.col("id") % 10 % 4).alias("c"))
    assert split.cluster_subsample(rows, "c", "id", 100, 5).count() == 100 and split.cluster_subsample(rows, "c", "id", 1000).count() == 1000


def test_profiles_of_empty_tables(spark):
    df = spark.createDataFrame([], "a double, y string, c bigint")
    assert [r["n_rows"] for r in profiles.table_profile(df).collect()] == [0, 0, 0]
    assert profiles.class_weights(df, "y").count() == 0
    assert metrics.distribution(df, "a").first()["mean"] is None


def test_attach_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (9, 6.0)], "cluster bigint, F1 double")
    feats = spark.createDataFrame([(1, 0.5, 3)], "cluster bigint, f1 double, cluster_class int")
    out = attach_features(df, feats, "cluster")
    assert out.columns == ["cluster", "f1"] and {(r[0], r[1]) for r in out.collect()} == {(1, 0.5), (9, None)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_knn_in_blocks_equals_brute_force(spark, metric, monkeypatch):
    df, x = _points(spark)
    monkeypatch.setattr(geometry, "BLOCK_BYTES", 600)
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in geometry.knn_graph(df, 5, metric=metric, n_cats=2).collect()}
    n = len(x)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = np.clip(1 - u @ u.T, 0, 1) * x.shape[1]
    else:
        d = (np.abs(x[:, None] - x[None]) / np.maximum(np.ptp(x, axis=0), 1e-8)).sum(2)
    i = np.arange(n)
    d = (d + (i[:, None] % 2 != i % 2) + (i[:, None] % 5 != i % 5)) / (x.shape[1] + 2)
    d[i, i] = np.inf
    for s in range(n):
        for r, t in enumerate(np.lexsort((i, np.round(d[s], 12)))[:5], 1):
            assert got[s, r][0] == t and abs(got[s, r][1] - d[s, t]) < 1e-9
    assert geometry.knn_graph(df.limit(1), 5).count() == 0 and geometry.knn_graph(df.limit(0), 5).count() == 0


def test_nearest_centroid_blocks_and_missing_class(spark, monkeypatch):
    df, x = _points(spark)
    cents = geometry.centroids(df.filter("class <> 1"), "cluster").join(df.select("cluster", "class").distinct(), "cluster")
    want = {r["id"]: r["assigned"] for r in geometry.nearest_centroid(df, cents, "cluster", within_class=True).collect()}
    monkeypatch.setattr(geometry, "BLOCK_BYTES", 40)
    got = {r["id"]: r["assigned"] for r in geometry.nearest_centroid(df, cents, "cluster", within_class=True).collect()}
    assert got == want and all((a == -1) == (i % 3 == 1) for i, a in got.items())


def test_pca_and_spanning_tree(spark):
    df, x = _points(spark, 90, 6)
    got = {r["cluster"]: (r["t3"], r["t4"]) for r in complexity.pca_ratios(df.repartition(5)).collect()}
    for c, (t3, t4) in got.items():
        rows = x[[i for i in range(90) if (i % 3) * 2 + (i // 3) % 2 == c]]
        v = np.linalg.eigvalsh(np.cov(rows.T))[::-1]
        k = min(int(np.searchsorted(np.cumsum(v) / v.sum(), 0.95)) + 1, *rows.shape)
        assert abs(t3 - k / len(rows)) < 1e-12 and abs(t4 - k / 6) < 1e-12
    single = spark.createDataFrame([(1, 5, [1.0, 2.0])], "id bigint, cluster bigint, x array<double>")
    assert complexity.pca_ratios(single).first()["t3"] is None
    edges = geometry.knn_graph(df, 3)
    tree = complexity.spanning_tree(edges, df).collect()
    assert len(tree) == 89
    # the links between parts come from the first part's smallest id, by the graph's distance
    _, parts = complexity.spanning_forest(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("dist").alias("w")))
    comp = {r["id"]: r["comp"] for r in parts.collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    gaps = np.minimum(((unit - unit[0]) ** 2).sum(axis=1) / 2, 1)
    for r in tree:
        if comp[r["u"]] != comp[r["v"]]:
            part = [i for i in range(90) if comp[i] == comp[r["v"]]]
            assert r["u"] == 0 and abs(r["w"] - max(min(gaps[part]), 1e-10)) < 1e-9


def test_silhouette_blocks(spark):
    df, _ = _points(spark)
    a = {r["id"]: r["s"] for r in complexity.silhouette(df).collect()}
    b = {r["id"]: r["s"] for r in complexity.silhouette(df, block_rows=7).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a)


def test_curves_are_bounded_and_monotone(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 4, float(rng.integers(0, 5)) / 5, float(rng.random()), int(rng.integers(1, 20))) for i in range(80)]
    df = spark.createDataFrame(rows, "ordinal int, class int, score double, rate double, support int")
    c = curves.risk_coverage(df).orderBy("pos").collect()
    cov = [r["coverage"] for r in c]
    assert cov == sorted(cov) and abs(cov[-1] - 1) < 1e-12 and all(0 <= r["accuracy"] <= 1 for r in c)
    s = curves.curve_summary(curves.risk_coverage(df), "accuracy").first()
    acc = [r["accuracy"] for r in c]
    grid = np.linspace(0, 1, 101)
    assert abs(s["aurc"] - np.trapezoid(np.interp(grid, cov, acc), grid)) < 1e-9
    assert abs(s["at_target"] - np.interp(0.8, cov, acc)) < 1e-9
    assert curves.risk_coverage(df.withColumn("support", F.lit(0))).count() == 0


def test_correlation_p_value():
    # t = 2 with 10 degrees of freedom has a two-sided p of 0.07338803477074039
    rho = 2 / math.sqrt(10 + 4)
    assert abs(metrics.correlation_p_value(rho, 12) - 0.07338803477074039) < 1e-10
    assert metrics.correlation_p_value(0.5, 2) is None and metrics.correlation_p_value(1.0, 9) == 0.0


@pytest.mark.parametrize("name", ["kmeans", "gmm", "birch", "spectral", "kprototypes", "hdbscan"])
def test_clusterers_find_separate_groups(name):
    rng = np.random.default_rng(3)
    truth = np.repeat(np.arange(3), 40)
    x = rng.standard_normal((120, 3)) * 0.1 + np.eye(3)[truth] * 5
    args = {"hdbscan": {"min_cluster_size": 10, "min_samples": 3, "method": "eom"}, "birch": {"n_clusters": 3, "threshold": 1.0}}.get(name, {"n_clusters": 3})
    label = clustering.REGISTRY[name](x, truth[:, None] if name == "kprototypes" else None, **args)
    assert all(len(set(label[truth == t])) == 1 for t in range(3)) and len(set(label)) == 3


def test_cluster_ids_run_over_classes(spark):
    df, _ = _points(spark, 90)
    labels, cents = clustering.cluster_per_class(df, "kmeans", {"n_clusters": [2, 3]}, max_fit=20, floor=2)
    rows = {r["id"]: r["cluster"] for r in labels.collect()}
    assert len(rows) == 90
    owner = {}
    for i, c in rows.items():
        assert owner.setdefault(c, i % 3) == i % 3
    with pytest.raises(ValueError):
        clustering.one_algorithm({"kmeans": {}, "gmm": {}})
    assert clustering.clusters_band(1000) == sorted(set(clustering.clusters_band(1000))) and clustering.size_floor(10, 10) == 5


def test_bootstrap_is_repeatable_and_fair(spark):
    rng = np.random.default_rng(0)
    rate = rng.random(40)
    draws = resample.bootstrap_draws(spark, {"good": rate + 0.01, "bad": rng.random(40)}, rate, np.ones(40), n=120)
    again = resample.bootstrap_draws(spark, {"good": rate + 0.01, "bad": rng.random(40)}, rate, np.ones(40), n=120)
    assert {r["lift"] for r in draws.filter("name = 'good'").collect()} == {r["lift"] for r in again.filter("name = 'good'").collect()}
    out = {(r["name"], r["measure"]): r for r in resample.intervals(draws, "good").collect()}
    assert out["good", "spearman"]["mean"] > 0.99 and out["bad", "spearman"]["significant"] and not out["good", "lift"]["significant"]


def test_attributions_add_up(spark):
    df, x = _points(spark, 12)
    w = np.array([1.0, -2.0, 0.5, 0.0])
    got = models.shapley_values(lambda a: a @ w, x[:5], df).collect()
    for r in got:
        assert np.allclose(r["values"], w * (x[r["id"]] - x[:5].mean(0)), atol=1e-6)


def test_focal_loss():
    p, y = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]]), np.array([0, 1, -1])
    assert abs(models.focal_loss(p, y, gamma=0) + np.log([0.9, 0.8]).mean()) < 1e-12
    assert models.focal_loss(p, y) < models.focal_loss(p, y, gamma=0)


def test_model_queries_cover_every_row(spark, tmp_path):
    from gneiss import queries_models

    rng = np.random.default_rng(3)
    rows = [(i + 100, i % 5, [float(v) for v in rng.standard_normal(64) + i % 5]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries_models.attributions(spark, str(tmp_path))
    assert got.count() == 60 * 64 and got.select("id").distinct().count() == 60
    boosted = queries_models.boosted_predictions(spark, str(tmp_path)).collect()
    assert sorted(r["id"] for r in boosted) == [r[0] for r in rows if r[0] % 5 == 0]


def test_boosted_predictions_cover_every_class(spark, tmp_path):
    from gneiss import queries_models

    rng = np.random.default_rng(4)
    rows = [(i, i % 4, [float(v) for v in rng.standard_normal(64) + 4 * (i % 4)]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries_models.boosted_predictions(spark, str(tmp_path)).collect()
    assert {r["y"] for r in got} == {0, 1, 2, 3} and 3 in {r["p"] for r in got}


def test_hdbscan_rows_outside_the_fit_can_be_noise(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((150, 2)) * 0.1, rng.standard_normal((150, 2)) * 0.1 + 5, rng.uniform(-400, 400, (60, 2))])
    df = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id bigint, class int, x array<double>")
    labels, _ = clustering.cluster_per_class(df, "hdbscan", {"min_cluster_size": 20, "min_samples": 5, "method": "eom"}, max_fit=180)
    rows = {r["id"]: r for r in labels.collect()}
    assert len(rows) == 360
    assert np.mean([rows[i]["is_noise"] for i in range(300)]) < 0.2 and np.mean([rows[i]["is_noise"] for i in range(300, 360)]) > 0.8
    assert len({rows[i]["cluster"] for i in range(300) if not rows[i]["is_noise"]}) == 2


def test_cluster_bands_and_floors():
    # 10,000 rows: average sizes 50, 100, ... 3200
    assert clustering.clusters_band(10_000) == [3, 6, 12, 25, 50, 100, 200]
    assert clustering.clusters_band(10_000, cap=60) == [3, 6, 12, 25, 50, 60] and clustering.clusters_band(30) == [2]
    assert [clustering.size_floor(n) for n in (10_000, 30, 12)] == [20, 8, 5] and clustering.size_floor(10_000, 20) == 10


def test_kprototypes_over_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [float(v) for v in rng.standard_normal(3) * 0.1 + (i // 2 % 2) * 3 * (i % 2)], [i // 2 % 2, 7]) for i in range(240)]
    df = spark.createDataFrame(rows, "id bigint, class int, x array<double>, cats array<int>")
    with pytest.raises(ValueError):
        clustering.grid_search(df.drop("cats"), "kprototypes", [{"n_clusters": 2}])
    for most in (1000, 50):
        labels, _ = clustering.cluster_per_class(df, "kprototypes", {"n_clusters": [2, 3], "gamma": 5.0}, max_fit=most)
        got = {r["id"]: (r["cluster"], r["is_noise"]) for r in labels.collect()}
        assert len(got) == 240 and not any(noise for _, noise in got.values())
        # no cluster mixes classes or categories
        kinds = {}
        for i, (c, _) in got.items():
            kinds.setdefault(c, set()).add((i % 2, i // 2 % 2))
        assert all(len(k) == 1 for k in kinds.values())


def test_too_few_clusters_fall_back_to_the_whole_sweep(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 0, [float(v) for v in rng.standard_normal(2) + 9 * (i % 2)]) for i in range(60)], "id bigint, class int, x array<double>")
    combos = [{"n_clusters": 2}, {"n_clusters": 4}]
    assert clustering.grid_search(df, "kmeans", combos, min_clusters=50).first()["n_clusters"] == 2
    assert clustering.grid_search(df, "kmeans", combos, min_clusters=4).first()["n_clusters"] == 4


def test_models_take_their_parameters(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [float(v) for v in rng.standard_normal(2) + 4 * np.eye(3)[i % 3, :2]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, label int, x array<double>")
    assert [models.REGISTRY["logistic_regression"](100, C=c).getRegParam() for c in (0.01, 10.0)] == [1.0, 0.001]
    assert models.REGISTRY["random_forest"](1).getMaxDepth() == 30 and models.REGISTRY["decision_tree"](1, max_depth=4, n_jobs=2).getMaxDepth() == 4
    with pytest.raises(ValueError):
        models.REGISTRY["linear_svc"](100, C_=1.0)
    model = models.fit("logistic_regression", {"C": 10.0}, df)
    models.save_model(model, str(tmp_path / "m"))
    want = sorted((r["id"], r["p"]) for r in models.predict(model, df).collect())
    assert sorted((r["id"], r["p"]) for r in models.predict(models.load_model(str(tmp_path / "m")), df).collect()) == want
    for got in (models.calibrated_predict("linear_svc", {"max_iter": 20}, df, df), models.svm_rbf_predict(df, df, n=64, max_iter=20)):
        got = got.collect()
        assert all(abs(sum(r["proba"]) - 1) < 1e-9 and r["p"] == int(np.argmax(r["proba"])) for r in got)
        assert sum(r["p"] == r["y"] for r in got) > 270


def test_places_and_quantiles(spark):
    rng = np.random.default_rng(8)
    v = [float(x) for x in rng.integers(0, 40, 500)] + [7.0] * 300
    df = spark.createDataFrame([(i, x, None if i % 3 else x * 2) for i, x in enumerate(v)] + [(900, None, None), (901, NAN, NAN)], "id bigint, a double, b double")
    got = order.quantiles(df, {"a": F.col("a"), "b": F.col("b"), "none": F.lit(None)}, [0.0, 0.3, 0.5, 0.95, 1.0])
    assert np.allclose(got["a"], np.quantile(v, [0.0, 0.3, 0.5, 0.95, 1.0])) and got["none"] is None
    assert np.allclose(got["b"], np.quantile([x * 2 for i, x in enumerate(v) if i % 3 == 0], [0.0, 0.3, 0.5, 0.95, 1.0]))
    rows = order.with_places(df.filter("id < 901"), "a").collect()
    names = sorted(set(v))
    for r in rows:
        if r["a"] is not None:
            assert (r["_before"], r["_n"], r["_place"]) == (sum(x < r["a"] for x in v), v.count(r["a"]), names.index(r["a"]))
    assert len(rows) == 801 and order.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": None}


def test_random_ranks_equal_a_window(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 2, "big").when(F.col("id") % 10 == 2, F.lit(None)).otherwise("small").alias("y"))
    got = split._ranked(df, ["y"], "id", 5)
    w = Window.partitionBy("y").orderBy(split.order_key("id", 5), "id")
    assert got.withColumn("w", F.row_number().over(w)).filter("w <> _rank").count() == 0 and got.count() == 3000
    assert got.columns == ["id", "y", "_rank"]


@pytest.mark.parametrize(("loss", "weights"), [("cross_entropy", None), ("cross_entropy", (1.0, 2.0, 0.5)), ("focal", (1.0, 2.0, 0.5))])
def test_network_slopes(loss, weights):
    rng = np.random.default_rng(2)
    s = network.Settings(hidden=(5, 4), dropout=0.0, loss=loss, label_smoothing=0.1, class_weight=weights)
    net = network.Network(3, [4], 3, s)
    num, cats, y = rng.standard_normal((12, 3)), rng.integers(-1, 5, (12, 1)), rng.integers(-1, 3, 12)
    fresh = lambda: np.random.default_rng(0)

    def value():
        return network.loss_and_slope(net.forward(num, cats, fresh())[0], y, s)[0]

    logits, z, trail = net.forward(num, cats, fresh())
    grad = net.backward(network.loss_and_slope(logits, y, s)[1], z, trail)
    for k, w in net.w.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 6)]:
            old = w[at]
            w[at] = old + 1e-6
            up = value()
            w[at] = old - 1e-6
            down = value()
            w[at] = old
            assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-5, (k, at)


def test_network_learns_numbers_and_categories(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        c, x = i % 3, rng.standard_normal(2)
        rows.append((i, int((x[0] > 0) ^ (c == 1)), [float(v) for v in x], [c]))
    df = spark.createDataFrame(rows, "id bigint, label int, x array<double>, cats array<int>")
    net, history = network.fit_network(df.filter("id % 4 > 0"), df.filter("id % 4 = 0"), network.Settings(hidden=(16, 8), dropout=0.0, learning_rate=0.01))
    got = network.network_predict(net, df.filter("id % 4 = 0")).collect()
    assert sum(r["p"] == r["y"] for r in got) > 0.9 * len(got) and len(got[0]["z"]) == 8
    assert min(v for _, v in history) < history[0][1]
    assert network.network_predict(net, df.limit(0)).count() == 0
