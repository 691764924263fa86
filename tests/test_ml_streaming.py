import pytest
from pyspark.sql import functions as F

from fusionlens.operators import ml, scoring
from fusionlens.streaming import monitoring


def test_logistic_model_beats_nothing_and_scores(builds_small):
    res = ml.train_model(builds_small, "inbuild", "logistic_regression", params={"maxIter": 50})
    m = res["metrics"].first()
    assert 0.0 <= m["accuracy"] <= 1.0
    reqs = scoring.scoring_frame(builds_small.select("Sample_ID", *scoring.REQUEST_COLUMNS))
    scored = scoring.score_batch(res["model"], res["labels"], reqs)
    row = scored.first()
    assert abs(sum(row["class_probabilities"].values()) - 1.0) < 1e-9
    assert row["recommended_action"]


def test_request_missing_field_is_rejected(spark):
    good = '{"Alloy_Type":"Ti-6Al-4V","Powder_Morphology":"Spherical","Scan_Strategy":"Island",' + ",".join(
        f'"{c}":1.0' for c in scoring.REQUEST_COLUMNS[3:]) + "}"
    bad = good.replace('"Melt_Pool_Width_um":1.0,', "")
    df = spark.createDataFrame([(1, good), (2, bad)], "Sample_ID long, value string")
    out = {r["Sample_ID"]: r for r in scoring.parse_requests(df).collect()}
    assert out[1]["is_valid"] and not out[2]["is_valid"]
    assert out[2]["missing_fields"] == ["Melt_Pool_Width_um"]


def test_stream_drift_equals_batch_twin(spark, builds_small, tmp_path):
    src = str(tmp_path / "src")
    builds_small.write.parquet(src)
    sink = str(tmp_path / "sink")
    for _ in range(2):  # a second run finds no new files and changes nothing
        q = monitoring.stream_quality_drift(spark, src, spark.read.parquet(src).schema, sink, str(tmp_path / "ck"))
        q.awaitTermination()
        streamed = sorted(map(tuple, monitoring.newest_epoch(spark, sink).collect()))
        assert streamed == sorted(map(tuple, monitoring.quality_drift_window(builds_small).collect()))


def test_stream_inspection_means_take_late_rows_and_survive_a_restart(spark, builds_small, tmp_path):
    src, sink, ck = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    late = F.col("Sample_ID") % 3 == 0
    want = {}
    for part in (~late, late):  # the second run begins anew from the checkpoint and brings rows of old windows
        builds_small.where(part).write.mode("append").parquet(src)
        monitoring.stream_window_table(spark, src, builds_small.schema, sink, ck, monitoring.inspection_means()).awaitTermination()
        seen = spark.read.parquet(src)
        want = {r["window_start"]: r for r in monitoring.inspection_drift_window(seen).collect()}
        got = {r["window_start"]: r for r in monitoring.newest_epoch(spark, sink).collect()}
        assert set(got) == set(want) and len(got) > 1
        for w, r in got.items():
            assert r["samples"] == want[w]["samples"] and r["window_end"] == want[w]["window_end"]
            assert abs(r["mean_defect_count"] - want[w]["mean_defect_count"]) < 1e-9
    assert sum(r["samples"] for r in want.values()) == builds_small.where("event_time IS NOT NULL").count()


def test_process_drift_stream_holds_late_rows_against_a_frozen_baseline(spark, builds_small, tmp_path):
    src, sink, ck, base = (str(tmp_path / n) for n in ("src", "sink", "ck", "base"))
    early = builds_small.where("Sample_ID % 2 = 0")
    monitoring.freeze_baseline(monitoring.drift_baseline(early), base, 1)
    with pytest.raises(Exception, match="(?i)exists"):
        monitoring.freeze_baseline(monitoring.drift_baseline(builds_small), base, 1)
    late = F.col("Sample_ID") % 3 == 0

    def run(version):
        monitoring.stream_process_drift(spark, src, builds_small.schema, sink, ck, base, version).awaitTermination()
        return {(r["baseline_version"], r["window_start"], r["feature"]): r["psi"] for r in monitoring.newest_epoch(spark, sink).collect()}

    for part in (~late, late):  # the second run begins anew from the checkpoint and brings rows of old windows
        builds_small.where(part).write.mode("append").parquet(src)
        got = run(1)
        want = {(1, r["window_start"], r["feature"]): r["psi"]
                for r in monitoring.process_drift_psi(spark.read.parquet(src), baseline=early).collect()}
        assert set(got) == set(want) and len(got) > 4
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    monitoring.freeze_baseline(monitoring.drift_baseline(builds_small), base, 2)
    builds_small.where(late).write.mode("append").parquet(src)
    after = run(2)
    assert {k: v for k, v in after.items() if k[0] == 1} == got  # windows of version 1 keep their values
    fresh = monitoring.process_drift_psi(builds_small.where(late), baseline=builds_small)
    assert {k[1:] for k in after if k[0] == 2} == {(r["window_start"], r["feature"]) for r in fresh.collect()}


def test_a_replayed_scoring_batch_adds_nothing(spark, tmp_path):
    from fusionlens.operators import scoring

    good = "{" + ",".join(f'"{c}":"a"' for c in scoring.REQUEST_COLUMNS[:3]) + "," + ",".join(
        f'"{c}":1.0' for c in scoring.REQUEST_COLUMNS[3:]) + "}"
    batch = spark.createDataFrame([(1, good), (2, "{}")], "Sample_ID long, value string")
    valid, reject = str(tmp_path / "valid"), str(tmp_path / "reject")
    for epoch in (0, 0, 1):
        monitoring.score_epoch(batch, epoch, valid, reject, monitoring.rule_scorer)
    assert spark.read.parquet(valid).count() == 2 and spark.read.parquet(reject).count() == 2


def test_debounce_stream_equals_batch(spark, tmp_path):
    import datetime as dt
    day = dt.timedelta(days=30)
    t0 = dt.datetime(1995, 1, 5)
    base = dt.datetime(1970, 1, 1) + ((t0 - dt.datetime(1970, 1, 1)) // day) * day
    rows = []
    for i in (0, 1, 2, 5, 7, 8):  # runs: [0,1,2], [5], [7,8]
        rows.append((base + i * day, "psi:Laser_Power_W", 0.3 + i, 0.2))
    for i in (3, 4):
        rows.append((base + i * day, "quality_risk_rate", 6.0, 5.0))
    alerts = spark.createDataFrame(rows, "window_start timestamp_ntz, signal string, value double, threshold double")
    batch = sorted((r["signal"], r["window_start"]) for r in monitoring.debounce_alerts(alerts).collect())
    assert batch == [("psi:Laser_Power_W", base + 1 * day), ("psi:Laser_Power_W", base + 8 * day),
                     ("quality_risk_rate", base + 4 * day)]
    src = str(tmp_path / "alerts")
    alerts.write.parquet(src)
    q = monitoring.stream_debounce_alerts(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    streamed = sorted((r["signal"], r["window_start"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert streamed == batch


def test_compare_models_ml_small(builds_small):
    from fusionlens.plans.modeling import compare_models_ml

    out = compare_models_ml(builds_small, ["prebuild"], ["dummy", "logistic_regression"],
                            params={"logistic_regression": {"maxIter": 30}})
    comp = out["comparison"].collect()
    assert {r["model_type"] for r in comp} == {"dummy", "logistic_regression"}
    rec = out["recommendation"].first()
    assert rec["deployment_status"] in ("NOT_RECOMMENDED_FOR_DEPLOYMENT", "CANDIDATE_FOR_ENGINEERING_VALIDATION")
