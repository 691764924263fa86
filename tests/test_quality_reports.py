from pyspark.sql import functions as F

from fusionlens.operators import quality, stats


def test_schema_report_flags_missing_columns(six_rows):
    rep = quality.schema_report(six_rows).collect()
    fails = sorted(r["column"] for r in rep if r["status"] == "FAIL")
    assert fails == ["Melt_Pool_Width_um", "Shielding_Gas_Flow_L_min"]
    gate = quality.quality_gate(quality.data_quality_bundle(six_rows)).first()
    assert gate["status"] == "FAIL" and gate["fail_count"] == 2


def test_duplicates_counts_appended_copy(six_rows):
    assert quality.duplicate_rows(six_rows).first()["duplicate_count"] == 0
    doubled = six_rows.unionByName(six_rows.filter(F.col("Sample_ID") == 1))
    row = quality.duplicate_rows(doubled).first()
    assert row["duplicate_count"] == 1 and row["status"] == "WARN"


def test_missing_values_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    rep = {r["column"]: r for r in quality.missing_values(df).collect()}
    assert rep["x"]["missing_count"] == 2 and rep["x"]["missing_percent"] == 50.0
    assert rep["s"]["missing_count"] == 1 and rep["s"]["status"] == "WARN"


def test_target_checks_unknown_label(spark):
    df = spark.createDataFrame([("Poor",), ("Unknown",), (None,)], "Quality_Class string")
    rows = quality.target_label_check(df).collect()
    assert ("unexpected_target_label", "Unknown", "FAIL") in [tuple(r) for r in rows]
    assert {r["value"] for r in rows if r["status"] == "WARN"} == {"Moderate", "Good", "Excellent"}
    dist = {r["value"]: r["count"] for r in quality.target_distribution(df).collect()}
    assert dist[None] == 1


def test_physical_ranges_null_never_invalid(spark):
    df = spark.createDataFrame([(-1.0, 101.0), (None, None), (5.0, 50.0)], "Laser_Power_W double, Porosity_percent double")
    rep = {r["column"]: r["invalid_count"] for r in quality.physical_ranges(df).collect()}
    assert rep == {"Laser_Power_W": 1, "Porosity_percent": 1}


def test_outlier_quartiles_and_skewness(six_rows):
    out = {r["feature"]: r for r in stats.iqr_outliers(six_rows).collect()}
    assert abs(out["Laser_Power_W"]["q1"] - 227.5) < 1e-9 and abs(out["Laser_Power_W"]["q3"] - 295.0) < 1e-9
    sk = {r["feature"]: r["skewness"] for r in stats.skewness_report(six_rows).collect()}
    expected = six_rows.select("Laser_Power_W").toPandas()["Laser_Power_W"].skew()
    assert abs(sk["Laser_Power_W"] - round(expected, 4)) < 1e-12


def test_correlation_guard_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.1)], "a double, c double, b double")
    rows = {(r["feature_a"], r["feature_b"]): r["correlation"]
            for r in stats.correlation_long(df, ["a", "c", "b"]).collect()}
    import numpy as np
    expected = np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.0, 6.1])[0, 1]
    assert rows[("a", "c")] is None and abs(rows[("a", "b")] - expected) < 1e-12


def test_class_balance_ratio(six_rows):
    rows = stats.class_balance(six_rows).collect()
    assert {r["imbalance_ratio_majority_to_minority"] for r in rows} == {2.0}
    assert {r["status"] for r in rows} == {"PASS"}


def test_constant_verdicts_equal_the_exact_report(spark):
    from fusionlens.operators import stats

    limit = stats.THRESHOLDS["near_constant_ratio"]
    n = 20_000
    at = int(limit * n)
    df = spark.range(n).select(
        F.lit(3.5).alias("one"), F.lit(None).cast("string").alias("nulls"),
        F.when(F.col("id") > 0, 1.0).alias("one_and_null"), (F.col("id") % 3).alias("few"),
        (F.col("id") % (at - 1)).alias("just_below"), (F.col("id") % at).alias("at_limit"),
        (F.col("id") % (2 * at)).cast("string").alias("above"), F.col("id").alias("key"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("nans"))
    for rows in (df, df.limit(0), df.limit(1)):
        exact = stats.constant_features(rows).select("feature", "status", "interpretation").collect()
        assert sorted(stats.constant_verdicts(rows).collect()) == sorted(exact)


def test_categories_become_codes_row_by_row(spark):
    from fusionlens.operators import stats

    df = spark.createDataFrame([(1, "b", "x"), (2, None, "x"), (3, "a", None), (4, "b", "x")], "Sample_ID long, p string, q string")
    got = {r["Sample_ID"]: (r["p"], r["q"]) for r in stats.category_fill_encode(df, ["p", "q"]).collect()}
    # codes in sorted order of the texts: Missing, a, b and Missing, x
    assert got == {1: (2.0, 1.0), 2: (0.0, 1.0), 3: (1.0, 0.0), 4: (2.0, 1.0)}
