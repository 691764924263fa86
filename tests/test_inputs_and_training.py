"""Inputs that the generated tables do not have: NaN, other CSV headers, text ids, many classes."""


import pytest
from fusionlens.contract import CATEGORICAL, EXPECTED_COLUMNS, INBUILD_MONITORING, POST_BUILD, TARGET, known_too_late, scenario_columns
from fusionlens.functions.exprs import guarded_corr
from fusionlens.operators import binned, challenge, evaluation, ml, quality, stats
from fusionlens.sources import files
from fusionlens.streaming import monitoring
from pyspark.sql import functions as F

NAN = float("nan")


def with_nan(df, column):
    """The table with NaN where Sample_ID is 2 and NULL where it is 5."""
    return df.withColumn(column, F.when(F.col("Sample_ID") == 2, F.lit(NAN)).when(F.col("Sample_ID") != 5, F.col(column)))


def without(df, column):
    return df.withColumn(column, F.when(~F.col("Sample_ID").isin(2, 5), F.col(column)))


def rows(df):
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted(map(lambda r: tuple(map(cell, r)), df.collect()), key=str)


@pytest.mark.parametrize("report", [quality.physical_ranges, stats.skewness_report, stats.correlation_pairs,
                                    stats.correlation_matrix, challenge.physics_correlations])
def test_nan_counts_as_missing(six_rows, report):
    for column in ("Porosity_percent", "Energy_Density_J_mm3"):
        assert rows(report(with_nan(six_rows, column))) == rows(report(without(six_rows, column)))


def test_nan_counts_as_missing_in_monitoring(builds_small):
    noisy = builds_small.withColumn("Laser_Power_W", F.when(F.col("Sample_ID") % 7 == 0, F.lit(NAN)).otherwise(F.col("Laser_Power_W")))
    clean = builds_small.withColumn("Laser_Power_W", F.when(F.col("Sample_ID") % 7 != 0, F.col("Laser_Power_W")))
    assert rows(monitoring.process_drift_psi(noisy)) == rows(monitoring.process_drift_psi(clean))
    noisy, clean = (d.withColumn("Porosity_percent", F.col("Laser_Power_W")) for d in (noisy, clean))
    assert rows(monitoring.inspection_drift_window(noisy)) == rows(monitoring.inspection_drift_window(clean))
    got, want = (monitoring.rolling_sensor_stats(d, "Laser_Power_W") for d in (noisy, clean))
    assert got.count() == want.count() and not got.where(F.isnan("rolling_mean")).count()


def test_guarded_correlation_skips_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (NAN, 1.0), (4.0, None)], "x double, y double")
    plain = df.where("NOT isnan(x) AND y IS NOT NULL")
    assert df.agg(guarded_corr("x", "y")).first()[0] == pytest.approx(plain.agg(F.corr("x", "y")).first()[0])


def test_csv_is_read_by_its_header(spark, six_rows, tmp_path):
    path = str(tmp_path / "builds")
    shuffled = six_rows.withColumn(
        "operator note", F.lit("ok")).select("operator note", *reversed(six_rows.columns))
    shuffled.coalesce(1).write.option("header", True).csv(path)
    df = files.scan_csv_contract(spark, path)
    assert rows(df.select(*six_rows.columns)) == rows(six_rows)
    assert set(df.columns) == {*six_rows.columns, "operator note", "_corrupt_record"}
    assert df.where("_corrupt_record IS NOT NULL").count() == 0
    report = quality.schema_report(df.drop("_corrupt_record", "operator note"))
    assert report.where("status = 'FAIL'").count() == 2
    assert quality.quality_gate(quality.data_quality_bundle(df.drop("_corrupt_record"))).first()["status"] == "FAIL"


def test_csv_keeps_bad_rows(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Laser_Power_W,Sample_ID,Quality_Class\n200,1,Good\nabc,2,Good\nN/A,3,nan\n210,4\n220,5,Poor,more\n")
    got = {r["Sample_ID"]: r for r in files.scan_csv_contract(spark, str(path)).collect()}
    assert got[1]["_corrupt_record"] is None and got[1]["Laser_Power_W"] == 200.0
    assert got[2]["Laser_Power_W"] is None and got[2]["_corrupt_record"] == "abc,2,Good"
    assert got[3]["Laser_Power_W"] is None and got[3]["Quality_Class"] is None and got[3]["_corrupt_record"] is None
    assert got[4]["_corrupt_record"] == "210,4" and got[5]["_corrupt_record"] == "220,5,Poor,more"


def test_noise_in_many_classes_is_weak(spark):
    df = spark.range(800).select(
        F.col("id").alias("Sample_ID"), F.concat(F.lit("c"), (F.col("id") % 8).cast("string")).alias(TARGET),
        F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("Laser_Power_W"))
    r = challenge.kruskal_separation(df).collect()[0]
    assert r["degrees_of_freedom"] == 7 and r["p_value"] > 0.05 and "weak" in r["class_separation_signal"].lower()


def test_all_process_points(builds_small):
    assert binned.process_points(builds_small).count() == builds_small.count()
    assert binned.process_points(builds_small, 0.1).count() < builds_small.count() / 5


@pytest.fixture(scope="module")
def forty_rows(spark):
    kinds = ["Poor", "Moderate", "Good", "Excellent"]
    base = spark.range(40).select(F.format_string("S%03d", "id").alias("Sample_ID"), F.col("id").cast("int").alias("i"))
    cols = [F.lit("x").alias(c) for c in CATEGORICAL]
    cols += [(F.col("i") % 4 * 10.0 + F.col("i") / 40).alias(c) for c in EXPECTED_COLUMNS
             if c not in CATEGORICAL + ["Sample_ID", TARGET, "Defect_Count"]]
    return base.select("Sample_ID", *cols, (F.col("i") % 4).alias("Defect_Count"),
                       F.element_at(F.array(*map(F.lit, kinds)), F.col("i") % 4 + 1).alias(TARGET))


def test_stratified_split_holds_out_the_exact_share(spark, forty_rows):
    counts = {(r[TARGET], r["is_test"]): r["count"] for r in ml.stratified_split(forty_rows, 0.25).groupBy(TARGET, "is_test").count().collect()}
    assert all(counts[k, True] == 3 and counts[k, False] == 7 for k in ("Poor", "Moderate", "Good", "Excellent"))
    few = spark.createDataFrame([(f"a{i}", "rare" if i < 3 else "common") for i in range(40)], f"Sample_ID string, {TARGET} string")
    split = ml.stratified_split(few, 0.2)
    assert split.where("is_test").groupBy(TARGET).count().orderBy(TARGET).collect() == [("common", 7), ("rare", 1)]
    one = spark.createDataFrame([(i, "rare" if i < 1 else "common") for i in range(40)], f"Sample_ID long, {TARGET} string")
    assert ml.stratified_split(one, 0.25).where("is_test").count() == 10
    assert split.count() == 40 and split.columns == ["Sample_ID", TARGET, "is_test"]


def test_text_ids_train_a_forest(forty_rows):
    found = ml.train_model(forty_rows, "inbuild", "random_forest", 0.25, params={"trees": 60, "max_depth": 5, "min_leaf": 1})
    r = found["metrics"].first()
    assert found["predictions"].count() == 12 and r["accuracy"] > 0.8


def test_saved_pipeline_fills_as_training_did(spark, builds_small, tmp_path):
    features = scenario_columns("inbuild")
    train = builds_small.select("Sample_ID", *features, TARGET).limit(400).withColumn(
        "Alloy_Type", F.when(F.col("Sample_ID") % 5 != 0, F.col("Alloy_Type"))).withColumn(
        "Laser_Power_W", F.when(F.col("Sample_ID") % 3 == 0, F.lit(NAN)).otherwise(F.col("Laser_Power_W"))).cache()
    pipe = ml.build_pipeline(ml.with_class_weights(train), features, "logistic_regression", 1.0, params={"maxIter": 5})
    model = pipe.fit(ml.with_class_weights(train))
    filled = model.stages[1].transform(train)
    want = stats.median_fill(train.select("Laser_Power_W", "Energy_Density_J_mm3"))
    assert rows(filled.select("Laser_Power_W__imp", "Energy_Density_J_mm3__imp")) == rows(want)
    mode = train.where("Alloy_Type IS NOT NULL").groupBy("Alloy_Type").count().orderBy(F.desc("count"), "Alloy_Type").first()[0]
    assert filled.where("Alloy_Type IS NULL").select("Alloy_Type__imp").distinct().collect() == [(mode,)]
    ml.save_model(model, {"scenario": "inbuild"}, str(tmp_path / "m"))
    again, _ = ml.load_model(spark, str(tmp_path / "m"))
    assert rows(model.transform(train).select("Sample_ID", "prediction")) == rows(again.transform(train).select("Sample_ID", "prediction"))


def test_metrics_of_labels_outside_the_contract(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("Poor", "c"), (None, "a"), ("a", None)]
    r = evaluation.classification_metrics(spark.createDataFrame(pairs, "label string, prediction string"), []).first()
    assert r["accuracy"] == pytest.approx(5 / 7)
    assert r["balanced_accuracy"] == pytest.approx((3 / 4 + 1 + 0) / 3)
    f1 = {"a": 6 / 7, "b": 4 / 5, "Poor": 0, "c": 0}
    assert r["macro_f1"] == pytest.approx(sum(f1.values()) / 4)
    assert r["weighted_f1"] == pytest.approx((4 * f1["a"] + 2 * f1["b"]) / 7) and r["risk_recall"] == 0


def test_roles_follow_the_stages():
    assert scenario_columns("inbuild")[-len(INBUILD_MONITORING):] == INBUILD_MONITORING
    assert known_too_late("inbuild", ["Sample_ID", "Laser_Power_W", "Defect_Count", "my_target", "note"]) == [
        "Sample_ID", "Defect_Count", "my_target"]
    assert set(POST_BUILD) <= set(scenario_columns("postbuild"))


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from fusionlens import session

    class Context:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_eda_run_on_a_csv_stops_at_missing_columns(spark, six_rows, tmp_path):
    from fusionlens.plans.eda import run_eda

    path = str(tmp_path / "builds.csv")
    six_rows.coalesce(1).write.option("header", True).csv(path)
    run = run_eda(spark, path, str(tmp_path / "out"))
    assert run["exit_code"] == 1 and run["gate"]["status"] == "FAIL" and "schema" in run["reports"]
    assert spark.read.parquet(str(tmp_path / "out" / "_audit")).first()["rows"] == 6


def test_registered_fits_are_the_whole_ladder_at_reference_settings(spark, monkeypatch):
    from conftest import SF
    from fusionlens.operators import ml
    from fusionlens.operators.trees import BoostSettings, ForestSettings
    from fusionlens.plans import registry

    asked = []

    def train(df, scenario, model_type, test_size=0.2, seed=42, params=None, prepared=None):
        asked.append((scenario, model_type, params))
        return {"metrics": spark.createDataFrame([(scenario, model_type)], "scenario string, model_type string")}

    def grid(df, scenarios, model_types, out_dir, params=None, test_size=0.2, seed=42, at_once=4):
        asked.extend((s, m, params) for s in scenarios for m in model_types)
        return spark.createDataFrame([(s, m, 0.5) for s in scenarios for m in model_types], "scenario string, model_type string, accuracy double")

    monkeypatch.setattr(ml, "train_model", train)
    monkeypatch.setattr(ml, "training_grid", grid)
    monkeypatch.setattr(ml, "load_model", lambda *a: (_ for _ in ()).throw(LookupError("grid was asked for")))
    with pytest.raises(LookupError):
        registry.QUERIES["training_grid"](spark, SF)
    for name in ("model_forest", "model_boosting"):
        registry.QUERIES[name](spark, SF)
    assert {a[:2] for a in asked} == {(s, m) for s in ("prebuild", "inbuild", "postbuild") for m in ml.MODEL_TYPES}
    assert all(params is None for _, _, params in asked) and len(asked) == 14
    assert ForestSettings(**ml.FOREST) == ForestSettings(300, 2, None) and BoostSettings(**ml.BOOSTING) == BoostSettings(300, 0.05, 0.1, 31, 20)
