import pytest
from pyspark.sql import functions as F

from gneiss.operators import clean
from gneiss.sources import config, files, synthetic


def test_csv_reads_infinities_and_missing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a.b,"k, l"\n1.5,x\ninf,\n-inf,y\nnan,z\n,"q,r"\n')
    rows = files.read_table(spark, str(tmp_path / "t.csv"), ["a.b"]).collect()
    assert [r[1] for r in rows] == ["x", None, "y", "z", "q,r"] and rows[1][0] == float("inf") and rows[4][0] is None
    with pytest.raises(ValueError):
        files.read_table(spark, "t.xyz")


def test_tables_json_and_markers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"))], "k int, v double")
    path = str(tmp_path / "t.parquet")
    assert not files.stage_done([path])
    files.write_table(df, path)
    assert files.stage_done([path]) and not files.stage_done([path], force=True)
    assert files.nan_to_null(files.read_table(spark, path)).first()["v"] is None
    sink = files.ArtifactSink(str(tmp_path / "out"))
    assert sink.publish({"json/a": {1: float("nan")}, "other/b": 1, "figure/c": b"x", "table/d": df}) == ["json/a", "figure/c", "table/d"]
    assert files.read_json(str(tmp_path / "out/json/a.json")) == {"1": None}
    with pytest.raises(ValueError):
        files.write_table(df, "t.xyz")

    @files.timed
    def step():
        return df

    step()
    files.flush_timings(str(tmp_path / "timing.json"))
    assert files.read_json(str(tmp_path / "timing.json"))[0]["function"] == "step" and not files.TIMINGS


def test_run_tree(spark, tmp_path):
    for v, f, c in (("base", "flows_1_42", "knn"), ("base", "plain", "lda")):
        files.write_json({"rho": 0.5}, str(tmp_path / v / f / c / "res.json"))
    rows = {tuple(r) for r in files.run_tree(spark, str(tmp_path), "res.json").collect()}
    assert rows == {("base", "flows_1", 42, "knn", 0.5), ("base", "plain", None, "lda", 0.5)}
    assert files.parse_dataset_dir("a_b_7") == ("a_b", 7) and files.parse_dataset_dir("ab") == ("ab", None)


def test_config(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/seeds.yaml").write_text("label_col: class\nnum_cols: [a, b]\nname: seeds\n")
    (tmp_path / "data/other.yaml").write_text("label_col: y\nname: other\n")
    (tmp_path / "config.yaml").write_text("defaults: [{data: seeds}, _self_]\nseed: 42\nout: runs/${data.name}_${seed}\nn: ${seed}\n")
    cfg = config.load_config(str(tmp_path))
    assert cfg["out"] == "runs/seeds_42" and cfg["n"] == 42
    cfg = config.load_config(str(tmp_path), overrides=["data=other", "seed=7", "data.top_n=5"])
    assert cfg["out"] == "runs/other_7" and cfg["data"]["top_n"] == 5
    spec = config.DatasetSpec.load(str(tmp_path / "data/seeds.yaml"))
    assert spec.num_cols == ("a", "b") and spec.extra == {"name": "seeds"}
    with pytest.raises(ValueError):
        config.DatasetSpec("y", train_frac=0.5)


def test_synthetic_structure(spark):
    t = synthetic.synthetic_table(spark, 7000, n_inf=30, n_nan=20)
    from gneiss.plans.scratch import materialize

    t = materialize(t)
    sizes = {r["label"]: r["count"] for r in t.groupBy("label").count().collect()}
    assert sizes["class_10"] == 500 and sum(sizes.values()) == t.count()
    assert t.filter("isnan(num_3)").count() == 20
    assert t.filter(F.expr("num_7 = double('inf') or num_8 = double('inf')")).count() == 30
    assert t.filter("cat_2 = 'W' and label <> 'class_8'").count() == 0
    cleaned = clean.rare_category_filter(clean.drop_nonfinite(t, ["num_3", "num_7", "num_8"]), ["label"], 600)
    assert cleaned.filter("label = 'class_10'").count() == 0
    shifted = cleaned.filter("label = 'class_3'").groupBy("true_subgroup").agg(*[F.avg(f"num_{i}").alias(f"m{i}") for i in range(1, 21)]).collect()
    away = {r[0]: sum(abs(v - 5) for v in r[1:]) for r in shifted}
    assert away["canonical"] > away["medium"] > away["evasive"]
