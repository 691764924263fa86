import pandas as pd
from pyspark.sql import functions as F

from fusionlens.operators import challenge, ranks
from fusionlens.operators.binned import histogram, process_window_risk


def test_exact_quantiles_match_pandas_with_buckets(spark):
    vals = [float(x % 37) * 1.5 + (x % 5) * 0.1 for x in range(997)]
    df = spark.createDataFrame([("f", v) for v in vals], "feature string, value double")
    for b in (1, 7):
        q = ranks.quantiles_wide(df, ["feature"], {"q1": 0.25, "m": 0.5, "q3": 0.75}, buckets=b).first()
        s = pd.Series(vals)
        assert abs(q["q1"] - s.quantile(0.25)) < 1e-12 and abs(q["q3"] - s.quantile(0.75)) < 1e-12
        assert abs(q["m"] - s.median()) < 1e-12


def test_kruskal_on_six_rows(six_rows):
    rows = {r["feature"]: r for r in challenge.kruskal_separation(six_rows).collect()}
    r = rows["Defect_Count"]
    assert abs(r["kruskal_statistic"] - 4.7142857143) < 1e-8 and r["degrees_of_freedom"] == 3
    assert abs(r["p_value"] - 0.19395) < 1e-4


def test_kruskal_bucketed_equals_single_bucket(builds_small):
    a = {r["feature"]: r["kruskal_statistic"] for r in challenge.kruskal_statistics(builds_small, buckets=1).collect()}
    b = {r["feature"]: r["kruskal_statistic"] for r in challenge.kruskal_statistics(builds_small, buckets=9).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 * max(1.0, abs(a[k])) for k in a)


def test_energy_formula_and_defect_trend(six_rows):
    e = challenge.energy_formula_check(six_rows).first()
    assert e["status"] == "PASS" and e["rows_checked"] == 6
    trend = challenge.defect_trend(six_rows).collect()
    assert [r["mean"] for r in trend] == [9.5, 8.0, 5.5, 2.0]
    assert trend[1]["std"] is None and trend[0]["trend_check"].startswith("PASS")


def test_uniformity_one_per_bin(six_rows):
    u = {r["feature"]: r["uniformity_score"] for r in challenge.uniformity_scores(six_rows, ["Laser_Power_W"]).collect()}
    assert abs(u["Laser_Power_W"] - 1.0) < 1e-12


def test_bin_edges_left_vs_right_closed(spark):
    df = spark.createDataFrame([(v, "Poor") for v in (0.0, 2.0, 4.0, 6.0, 10.0)], "x double, Quality_Class string")
    h = {r["bin"]: r["count"] for r in histogram(df, ["x"], 5).collect()}
    assert h == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1}  # numpy.histogram: [0,2) [2,4) [4,6) [6,8) [8,10]
    df2 = df.withColumnRenamed("x", "Laser_Power_W").withColumn("Scan_Speed_mm_s", F.lit(1.0))
    cells = process_window_risk(df2, bins=5).collect()
    assert sorted((r["power_bin"], r["samples"]) for r in cells) == [(1, 2), (2, 1), (3, 1), (5, 1)]  # pandas.cut


def test_chi2_survival_points():
    assert abs(challenge.chi2_survival(7.814728, 3) - 0.05) < 1e-6
    assert abs(challenge.chi2_survival(5.991465, 2) - 0.05) < 1e-6


def test_registered_scorecard_has_the_model_row(spark):
    import duckdb

    from conftest import SF
    from fusionlens.operators import ml
    from fusionlens.plans import oracle, registry
    from fusionlens.sources.builds import builds

    got = {r["challenge"]: r["result"] for r in registry.QUERIES["realism_scorecard"](spark, SF).collect()}
    model = ml.quick_predictability(builds(spark, SF)).first()
    assert got.pop("Quick RF predictability") == "balanced acc=%.3f (random=%.3f)" % (
        model["balanced_accuracy"], model["random_chance_baseline"])
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = dict(con.execute(oracle.SQL["realism_scorecard_without_model"]).fetchall())
    want.pop("Quick RF predictability")  # SQL can not fit a forest
    assert len(got) == 5 and got == want
