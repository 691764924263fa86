import math

import duckdb
import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
FAST = ["process_window_risk", "missing_values", "physical_ranges", "class_balance", "skewness_report",
        "energy_bin_risk", "category_risk", "defect_trend", "confusion_matrix", "recommendation",
        "quality_drift_window", "scoring_frame"]


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0 and {"power_bin", "speed_bin", "samples", "risk_rate_percent"} <= set(df.columns)


def test_every_sql_key_is_registered():
    assert set(se.oracle_sql()) <= set(se.queries())


@pytest.mark.parametrize("key", FAST)
def test_matches_duckdb(spark, key):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    a = se.queries()[key](spark, SF).toPandas()
    b = con.execute(se.oracle_sql()[key]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)

    def rows(pdf):
        return sorted([tuple(None if (isinstance(v, float) and math.isnan(v)) else v for v in r)
                       for r in pdf[cols].astype(object).itertuples(index=False)], key=str)
    for x, y in zip(rows(a), rows(b)):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                assert (u is None and v is None) or math.isclose(float(u), float(v), rel_tol=1e-9, abs_tol=1e-9)
            else:
                assert str(u) == str(v)
