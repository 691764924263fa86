import numpy as np
import pandas as pd
from fusionlens.operators import order_stats
from fusionlens.operators.stats import iqr_outliers, median_fill
from pyspark.sql import functions as F


def test_quantiles_by_digits_equal_numpy(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "CHUNK_ROWS", 100)
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({
        "near": 1.0 + rng.random(n) * 1e-13, "wide": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n),
        "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(-3, 3, n)), "one": np.full(n, -0.0), "k": rng.choice(["a", "b", None], n)})
    pdf.loc[rng.random(n) < 0.1, "wide"] = np.nan
    pdf.loc[:5, "wide"] = [np.inf, -np.inf, 0.0, -0.0, 5e-324, -5e-324]
    df = spark.createDataFrame(pdf).repartition(5)
    columns, probs = ["near", "wide", "hot", "one"], {"a": 0.25, "b": 0.5, "c": 0.999, "d": 1.0, "e": 0.0}
    for by in (None, "k"):
        got = {(r["feature"], r["by"]): r for r in order_stats.exact_quantiles(df, columns, probs, by)}
        assert len(got) == (4 if by is None else 8)
        for (c, k), r in got.items():
            x = np.sort((pdf if k is None else pdf[pdf["k"] == k])[c].dropna().to_numpy())
            assert r["n"] == len(x)
            for name, p in probs.items():
                want = order_stats.interpolate(dict(enumerate(x.tolist())), len(x), p)
                assert r[name] == want or (np.isnan(r[name]) and np.isnan(want)), (c, k, name)
                if np.isfinite(want) and c != "wide":
                    assert np.isclose(want, np.quantile(x, p), rtol=1e-14)


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, float("nan"), 1)], "a double, b double, c int")
    assert [r["feature"] for r in order_stats.exact_quantiles(df, ["a", "b", "c"], {"m": 0.5})] == ["c"]
    assert order_stats.exact_quantiles(df.where("1 = 0"), ["a"], {"m": 0.5}) == []
    assert iqr_outliers(df).count() == 0
    assert median_fill(df, ["a", "c"]).select("a", "c").collect() == [(None, 1)]


def test_class_value_counts_equal_group_by(builds_small):
    got = order_stats.class_value_counts(builds_small, ["Laser_Power_W", "Porosity_percent"], "Quality_Class")
    want = builds_small.where("Quality_Class IS NOT NULL AND Laser_Power_W IS NOT NULL").groupBy("Laser_Power_W", "Quality_Class").count()
    assert sorted(tuple(r)[1:] for r in got.where(F.col("feature") == "Laser_Power_W").collect()) == sorted(map(tuple, want.collect()))
