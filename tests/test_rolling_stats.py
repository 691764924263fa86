import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fusionlens.operators import rolling

T0 = dt.datetime(1996, 2, 27)
SCHEMA = "machine string, event_time timestamp_ntz, x double"


def _rows():
    rng = np.random.default_rng(5)
    rows = []
    for machine, n in (("hot", 700), ("cold", 40), (None, 25), ("single", 1)):
        at = rng.integers(0, 60 * 24, n) * 3600  # whole hours of 60 days: many ties
        rows += [(machine, T0 + dt.timedelta(seconds=int(a)), float(v)) for a, v in zip(at, rng.normal(1600, 40, n).round(3))]
    rows += rows[:20]  # repeated rows
    rows += [("flat", T0 + dt.timedelta(days=d), 1500.0) for d in range(6)]
    return rows


def _plain(rows, days):
    """Every frame gathered by itself, moments around its own mean."""
    out = []
    for machine, at, x in rows:
        v = [b for m, u, b in rows if m == machine and at - dt.timedelta(days=days) <= u <= at]
        n, mean = len(v), math.fsum(v) / len(v)
        std = math.sqrt(math.fsum((b - mean) ** 2 for b in v) / (n - 1)) if n > 1 else None
        kurt = float(pd.Series(v).kurt()) if n > 3 and max(v) > min(v) else None
        out.append((str(machine), at, x, n, mean, std, max(v) / mean, kurt))
    return sorted(out, key=lambda r: r[:4])


def test_frames_equal_a_plain_version_at_every_part_size(spark):
    rows = _rows()
    odd = [("hot", None, 1.0), ("hot", T0, None), ("cold", T0, float("nan")), ("cold", T0, float("inf"))]  # left out
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("n", F.lit("extra"))
    for days, part_rows in ((7, rolling.PART_ROWS), (7, 50), (2, 1)):
        want = _plain(rows, days)
        got = sorted(((str(r[0]), *r[1:]) for r in rolling.rolling_stats(df, "x", "machine", days, part_rows).collect()),
                     key=lambda r: r[:4])
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g[:4] == w[:4]
            for a, b in zip(g[4:], w[4:]):
                assert (a is None and b is None) or abs(a - b) < 1e-9, (g, w)


def test_a_hot_machine_is_many_parts_and_a_span_is_in_one(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    seconds = df.select("machine", F.col("event_time").cast("timestamp").cast("long").alias("__t")).distinct()
    spans = seconds.withColumn("__span", F.floor(F.col("__t") / (2 * 86400)))
    parts = rolling._parts(spans, "machine", 50).collect()
    own = [(r["machine"], r["__span"]) for r in parts if not r["__halo"]]
    assert len(own) == len(set(own)) == spans.select("machine", "__span").distinct().count()
    assert len({r["__part"] for r in parts if r["machine"] == "hot"}) > 8


def test_empty_table_gives_no_rows(spark):
    assert rolling.rolling_stats(spark.createDataFrame([], SCHEMA), "x", "machine").collect() == []


def test_frame_maxima(spark):
    rng = np.random.default_rng(2)
    t = np.unique(rng.integers(0, 400, 150))
    x = rng.normal(size=len(t))
    start = rolling.frame_starts(t, 37)
    assert [max(x[s:i + 1]) for i, s in enumerate(start)] == list(rolling.frame_max(x, start))


def test_readings_of_keys_that_fit_a_task_are_shuffled_once(spark):
    plan = rolling.rolling_stats(spark.createDataFrame(_rows(), SCHEMA), "x", "machine")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
