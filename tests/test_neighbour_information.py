import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fusionlens.operators import neighbours, stats


def _psi(n: int) -> float:
    return -0.5772156649015329 + math.fsum(1.0 / i for i in range(1, int(n)))


def _brute_force(x: np.ndarray, y: np.ndarray, want: int = 3) -> float:
    classes, sizes = np.unique(y, return_counts=True)
    size = dict(zip(classes, sizes))
    use = np.array([size[c] > 1 for c in y], bool)
    x, y = x[use], y[use]
    terms = []
    for i in range(len(x)):
        others = np.delete(np.arange(len(x)), i)
        d = np.abs(x[others] - x[i])
        same = y[others] == y[i]
        r = np.sort(d[same])[min(want, size[y[i]] - 1) - 1]
        terms.append(_psi((d[same] <= r).sum()) - _psi(size[y[i]]) - _psi((d <= r).sum()))
    return max(0.0, _psi(len(x)) + math.fsum(terms) / len(x))


def _standard(x: np.ndarray, y: np.ndarray, want: int = 3) -> float:
    """The estimator for values without ties: rows strictly inside the radius, the row itself included."""
    terms = []
    for i in range(len(x)):
        d = np.abs(x - x[i])
        r = np.sort(d[y == y[i]])[want]
        terms.append(_psi(want) - _psi((y == y[i]).sum()) - _psi((d < r).sum()))
    return max(0.0, _psi(len(x)) + math.fsum(terms) / len(x))


def _counts(spark, features: dict, y):
    rows = [(f, float(v), str(c)) for f, x in features.items() for v, c in zip(x, y)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["feature", "value", "label"])).groupBy("feature", "value", "label").agg(
        F.count(F.lit(1)).alias("cj"))


@pytest.mark.parametrize("buckets", [1, 2, 9, 40])
def test_neighbour_information_equals_brute_force_with_ties(spark, buckets):
    rng = np.random.default_rng(5)
    # two large classes, one of two rows, one of a single row
    y = np.array(["a"] * 90 + ["b"] * 50 + ["c"] * 2 + ["d"])
    shift = np.where(y == "a", 0.0, 1.0)
    # integers, so that distances are exact and ties are many; a third of the rows hold one value
    features = {
        "tied": np.round(rng.normal(0, 3, len(y)) + 4 * shift),
        "hot": np.where(np.arange(len(y)) % 3 == 0, 7.0, rng.integers(-300, 300, len(y))),
        "sparse": rng.permutation(len(y)) * 64.0 + shift * 2048,
        "one": np.full(len(y), 2.0),
    }
    got = {r["feature"]: r["mi"] for r in neighbours.neighbour_mi(_counts(spark, features, y), "label", buckets=buckets).collect()}
    assert set(got) == set(features)
    for f, x in features.items():
        assert got[f] == pytest.approx(_brute_force(x, y), abs=1e-10), f


def test_neighbour_information_is_the_standard_estimate_without_ties(spark):
    rng = np.random.default_rng(6)
    y = np.repeat(["a", "b", "c"], 40)
    x = rng.normal(0, 1, len(y)) + np.repeat([0.0, 1.0, 4.0], 40)
    got = neighbours.neighbour_mi(_counts(spark, {"x": x}, y), "label", buckets=4).first()["mi"]
    assert got == pytest.approx(_standard(x, y), abs=1e-10)
    assert got > 0.4


def test_neighbour_information_edge_cases(spark):
    schema = "feature string, value double, label string, cj long"
    assert neighbours.neighbour_mi(spark.createDataFrame([], schema), "label").count() == 0
    rows = [("single", 1.0, "a", 1), ("single", 2.0, "b", 1),  # no class with two rows
            ("inf", float("inf"), "a", 5), ("inf", 1.0, "a", 4), ("inf", 9.0, "b", 4)]
    got = {r["feature"]: r["mi"] for r in neighbours.neighbour_mi(spark.createDataFrame(rows, schema), "label").collect()}
    assert set(got) == {"inf"}
    assert got["inf"] == pytest.approx(_brute_force(np.repeat([1.0, 9.0], 4), np.repeat(["a", "b"], 4)))


def test_report_fills_missing_values_and_numbers_categories(builds_small):
    df = builds_small.select("Sample_ID", "Laser_Power_W", "Alloy_Type", "Quality_Class").withColumn(
        "Laser_Power_W", F.when(F.col("Sample_ID") % 6 != 0, F.col("Laser_Power_W"))).withColumn(
        "Alloy_Type", F.when(F.col("Sample_ID") % 5 != 0, F.col("Alloy_Type"))).limit(400)
    pdf = df.orderBy("Sample_ID").toPandas()
    df = df.sparkSession.createDataFrame(pdf, df.schema)
    got = {r["feature"]: r["mutual_information_score"] for r in stats.mutual_information_neighbours(df, buckets=3).collect()}
    lab = pdf[pdf["Quality_Class"].notna()]
    y = lab["Quality_Class"].to_numpy()
    power = lab["Laser_Power_W"].astype("float64")
    codes = pd.Categorical(lab["Alloy_Type"].fillna("Missing")).codes.astype("float64")
    want = {"Laser_Power_W": _brute_force(power.fillna(power.median()).to_numpy(), y), "Alloy_Type": _brute_force(codes, y)}
    assert got == pytest.approx(want, abs=1e-6)
