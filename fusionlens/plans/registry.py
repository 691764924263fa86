"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Each reads the driver's tables through ``builds`` (only the columns it needs,
so Catalyst prunes the scans) and applies one operator over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fusionlens.operators import binned
from fusionlens.sources.builds import builds, written_builds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("process_window_risk")
def q_process_window_risk(spark, sf_dir):
    return binned.process_window_risk(builds(spark, sf_dir, ["Laser_Power_W", "Scan_Speed_mm_s", "Quality_Class"]))


from fusionlens.contract import CATEGORICAL, NUMERIC_TYPES  # noqa: E402,F401
from fusionlens.operators import quality, stats  # noqa: E402


def _b(spark, sf_dir, cols=None, extras=False):
    return builds(spark, sf_dir, cols, with_extras=extras)


QUERIES.update({
    "schema_report": lambda s, d: quality.schema_report(_b(s, d, extras=True)),
    "missing_values": lambda s, d: quality.missing_values(_b(s, d)),
    "duplicate_rows": lambda s, d: quality.duplicate_rows(_b(s, d)),
    "target_label_check": lambda s, d: quality.target_label_check(_b(s, d, ["Quality_Class"])),
    "target_distribution": lambda s, d: quality.target_distribution(_b(s, d, ["Quality_Class"])),
    "physical_ranges": lambda s, d: quality.physical_ranges(_b(s, d)),
    "data_quality_bundle": lambda s, d: quality.data_quality_bundle(_b(s, d)),
    "quality_gate": lambda s, d: _quality_gate(s, d),
    "iqr_outliers": lambda s, d: stats.iqr_outliers(_written_numbers(s, d)),
    "class_balance": lambda s, d: stats.class_balance(_b(s, d, ["Quality_Class"])),
    "correlation_pairs": lambda s, d: stats.correlation_pairs(_b(s, d)),
    "constant_features": lambda s, d: stats.constant_features(_b(s, d)),
    "constant_verdicts": lambda s, d: stats.constant_verdicts(_b(s, d)),
    "skewness_report": lambda s, d: stats.skewness_report(_b(s, d)),
    "leakage_candidates": lambda s, d: stats.leakage_candidates(_b(s, d)),
    "mutual_information": lambda s, d: stats.mutual_information(_written(s, d)),
    "mutual_information_neighbours": lambda s, d: stats.mutual_information_neighbours(_written(s, d)),
    "median_fill": lambda s, d: _median_fill(s, d),
    "category_fill_encode": lambda s, d: stats.category_codes(_b(s, d, CATEGORICAL), CATEGORICAL),
    "category_encode_rows": lambda s, d: stats.category_fill_encode(_b(s, d, ["Sample_ID", *CATEGORICAL]), CATEGORICAL),
    "production_risks": lambda s, d: _production_risks(s, d),
    "statistical_bundle": lambda s, d: stats.statistical_bundle(_written(s, d)),
})


def _median_fill(spark, sf_dir):
    df = _written_numbers(spark, sf_dir)
    return stats.median_fill(df, df.columns).select(*[F.col(c).cast("double").alias(c) for c in df.columns])


def _quality_gate(spark, sf_dir):
    df = _written(spark, sf_dir)
    return quality.quality_gate(quality.data_quality_bundle(df).unionByName(stats.statistical_bundle(df)))


def _production_risks(spark, sf_dir):
    df = _written(spark, sf_dir, [*numeric_columns(_b(spark, sf_dir)), *CATEGORICAL, TARGET])
    return stats.production_risks(stats.leakage_candidates(df), stats.iqr_outliers(df), stats.class_balance(df),
                                  stats.correlation_pairs(df))


from pyspark.sql import functions as F  # noqa: E402


from fusionlens.contract import PROCESS, POST_BUILD, TARGET, numeric_columns  # noqa: E402
from fusionlens.operators import challenge, evaluation, projections, selection, summary  # noqa: E402
from fusionlens.plans import candidates  # noqa: E402

SAFE_NUMERIC = PROCESS + POST_BUILD

QUERIES.update({
    "uniformity_score": lambda s, d: challenge.uniformity_scores(_b(s, d, SAFE_NUMERIC), SAFE_NUMERIC),
    "distribution_challenge": lambda s, d: challenge.distribution_challenge(_b(s, d)),
    "physics_correlations": lambda s, d: challenge.physics_correlations(_b(s, d)),
    "energy_formula_check": lambda s, d: challenge.energy_formula_check(_b(s, d)),
    "kruskal_separation": lambda s, d: challenge.kruskal_separation(_b(s, d)),
    "kruskal_p_values": lambda s, d: challenge.kruskal_separation(_b(s, d)),
    "defect_trend": lambda s, d: challenge.defect_trend(_b(s, d, ["Defect_Count", TARGET])),
    "leakage_identifiers": lambda s, d: challenge.leakage_identifiers(_b(s, d)),
    "challenge_bundle": lambda s, d: challenge.challenge_bundle(challenge.challenge_reports(_written(s, d), include_model=True)),
    "challenge_bundle_without_model": lambda s, d: challenge.challenge_bundle(challenge.challenge_reports(_written(s, d))),
    "realism_scorecard": lambda s, d: challenge.realism_scorecard(challenge.challenge_reports(_written(s, d), include_model=True)),
    "realism_scorecard_without_model": lambda s, d: challenge.realism_scorecard(challenge.challenge_reports(_written(s, d))),
    "numeric_summary": lambda s, d: summary.numeric_summary(_written_numbers(s, d)),
    "categorical_summary": lambda s, d: summary.categorical_summary(_b(s, d)),
    "histogram": lambda s, d: binned.histogram(_b(s, d, SAFE_NUMERIC), SAFE_NUMERIC, 20),
    "box_stats_by_class": lambda s, d: summary.box_stats_by_class(_written(s, d, SAFE_NUMERIC + [TARGET])),
    "category_by_class": lambda s, d: summary.category_by_class(_b(s, d)),
    "class_distribution": lambda s, d: summary.class_distribution(_b(s, d, [TARGET])),
    "quality_audit": lambda s, d: _quality_audit(s, d),
    "top_outlier_features": lambda s, d: summary.top_outlier_features(stats.iqr_outliers(_written_numbers(s, d))),
    "feature_group": lambda s, d: summary.feature_groups(_b(s, d)),
    "top_mi_features": lambda s, d: summary.top_mi_features(stats.mutual_information(_written(s, d))),
    "risk_ranking": lambda s, d: summary.risk_ranking(_production_risks(s, d)),
    "energy_bin_risk": lambda s, d: binned.energy_bin_risk(_b(s, d, ["Energy_Density_J_mm3", TARGET])),
    "category_risk": lambda s, d: binned.category_risk(_b(s, d, CATEGORICAL + [TARGET])),
    "process_window_pivot": lambda s, d: binned.process_window_pivot(
        _b(s, d, ["Laser_Power_W", "Scan_Speed_mm_s", TARGET])),
})


def _written(spark, sf_dir, cols=None):
    """The builds table written once, for reports that read it many times."""
    return written_builds(spark, sf_dir, shared_path(spark, "builds"), cols)


def _written_numbers(spark, sf_dir):
    return _written(spark, sf_dir, numeric_columns(_b(spark, sf_dir)))


def _quality_audit(spark, sf_dir):
    df = _b(spark, sf_dir)
    return summary.quality_audit(quality.schema_report(df), quality.missing_values(df), quality.duplicate_rows(df),
                                 quality.physical_ranges(df), stats.constant_verdicts(df))


def _pred(spark, sf_dir):
    return candidates.candidate_predictions(_b(spark, sf_dir, ["Sample_ID", TARGET] + candidates.RULE_COLUMNS))


def _cmp(spark, sf_dir):
    return selection.comparison_rows(evaluation.classification_metrics(_pred(spark, sf_dir), ["scenario", "model_type"]))


def _split_counts(spark, sf_dir):
    s = ml.stratified_split(_b(spark, sf_dir, ["Sample_ID", TARGET]))
    return s.groupBy(TARGET, F.when(F.col("is_test"), "test").otherwise("train").alias("split")).agg(
        F.count(F.lit(1)).alias("rows"))


QUERIES.update({
    "scenario_view": lambda s, d: projections.scenario_view(_b(s, d), "inbuild"),
    "model_frame": lambda s, d: projections.model_frame(_b(s, d), "prebuild"),
    "safe_features": lambda s, d: projections.safe_features(_b(s, d, extras=True)),
    "quality_ordinal": lambda s, d: projections.with_quality_ordinal(_b(s, d, ["Sample_ID", TARGET])),
    "risk_flag": lambda s, d: projections.with_risk_flag(_b(s, d, ["Sample_ID", TARGET])),
    "complete_cases": lambda s, d: projections.complete_cases(
        _b(s, d), ["Laser_Power_W", "Scan_Speed_mm_s", "Energy_Density_J_mm3", TARGET]),
    "labelled_rows": lambda s, d: projections.labelled_rows(_b(s, d)),
    "energy_density_calc": lambda s, d: projections.with_energy_density(
        _b(s, d, ["Sample_ID", "Energy_Density_J_mm3", "Laser_Power_W", "Scan_Speed_mm_s", "Hatch_Spacing_mm",
                  "Layer_Thickness_um"])).select("Sample_ID", "Energy_Density_J_mm3", "calculated_energy_density"),
    "stratified_split": _split_counts,
    "class_weights": lambda s, d: evaluation.class_weights(_b(s, d, [TARGET])).groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("rows"), F.max("class_weight").alias("class_weight")),
    "model_dummy": lambda s, d: _pred(s, d).filter(F.col("model_type") == "dummy").groupBy(
        "scenario", "label", "prediction").agg(F.count(F.lit(1)).alias("rows")),
    "confusion_matrix": lambda s, d: evaluation.confusion_matrix(_pred(s, d), ["scenario", "model_type"]),
    "classification_metrics": lambda s, d: evaluation.classification_metrics(_pred(s, d), ["scenario", "model_type"]),
    "risk_metrics": lambda s, d: evaluation.risk_metrics(_pred(s, d), ["scenario", "model_type"]),
    "per_class_metrics": lambda s, d: evaluation.per_class_metrics(_pred(s, d), ["scenario", "model_type"]),
    "compare_models": lambda s, d: selection.compare_models(_cmp(s, d)),
    "recommendation": lambda s, d: selection.recommendation(_cmp(s, d)),
    "best_per_scenario": lambda s, d: selection.best_per_scenario(_cmp(s, d)),
    "scenario_summary_join": lambda s, d: selection.scenario_summary_join(_cmp(s, d), selection.recommendation(_cmp(s, d))),
    "model_ladder": lambda s, d: selection.model_ladder(_cmp(s, d)),
    "comparison_union": lambda s, d: selection.comparison_union(
        *[_cmp(s, d).filter(F.col("scenario") == sc) for sc in ("prebuild", "inbuild", "postbuild")]),
    "comparison_sorted": lambda s, d: selection.comparison_sorted(_cmp(s, d)),
    "operational_subset": lambda s, d: projections.operational_subset(_cmp(s, d)),
    "selection_display": lambda s, d: projections.selection_display(_cmp(s, d)),
    "risk_f2_pivot": lambda s, d: selection.risk_f2_pivot(_cmp(s, d), ["dummy", "rule_baseline"]),
    "inbuild_tradeoff": lambda s, d: selection.inbuild_tradeoff(_cmp(s, d), ["dummy", "rule_baseline"]),
    "process_points": lambda s, d: binned.process_points(_b(s, d, ["Sample_ID", "Scan_Speed_mm_s", "Laser_Power_W", TARGET])),
})


# ---------------------------------------------------------------------------
# MLlib, scoring, sources and sinks
# ---------------------------------------------------------------------------

from fusionlens.operators import ml, scoring  # noqa: E402
from fusionlens.plans import modeling  # noqa: E402
from fusionlens.session import shared_path  # noqa: E402
from fusionlens.sources import files  # noqa: E402

# a saved file is checked on small ensembles; the fits at full settings are training_grid's
SAVED_SIZES = {"random_forest": {"trees": 20}, "hist_gradient_boosting": {"rounds": 20}}
_ML_COLS = ["Sample_ID"] + CATEGORICAL + PROCESS + POST_BUILD + [TARGET]


SCENARIOS = ["prebuild", "inbuild", "postbuild"]


def _training_rows(spark, sf_dir):
    return _written(spark, sf_dir, _ML_COLS)


def _metrics(spark, sf_dir, scenario, model_type):
    return ml.train_model(_training_rows(spark, sf_dir), scenario, model_type)["metrics"]


def _training_grid(spark, sf_dir):
    """The whole ladder in every scenario: metrics beside the number of stages and bytes of each reloaded artifact."""
    out = shared_path(spark, "grid")
    metrics = ml.training_grid(_training_rows(spark, sf_dir), SCENARIOS, ml.MODEL_TYPES, out)
    rows = []
    for s in SCENARIOS:
        for m in ml.MODEL_TYPES:
            model, meta = ml.load_model(spark, f"{out}/artifacts/scenario={s}/model_type={m}")
            rows.append((meta["scenario"], meta["model_type"], len(model.stages), meta["n_rows_train"], meta["n_rows_test"]))
    facts = spark.createDataFrame(rows, "scenario string, model_type string, stages int, n_rows_train long, n_rows_test long")
    return metrics.join(facts, ["scenario", "model_type"])


def _ladder(spark, sf_dir):
    return modeling.ladder_comparison(_training_rows(spark, sf_dir), SCENARIOS)


def _ladder_selection(spark, sf_dir):
    """One row per scenario: best model, lifts and status, and the risk F2 of every model of the fitted ladder."""
    rows = _ladder(spark, sf_dir)
    tables = modeling.selection_tables(rows)
    f2 = rows.groupBy("scenario").pivot("model_type", ml.MODEL_TYPES).agg(F.first("risk_f2")).withColumnsRenamed(
        {m: f"risk_f2_{m}" for m in ml.MODEL_TYPES})
    return tables["summary"].join(f2, "scenario")


def _requests(spark, sf_dir, rows=None):
    """Request records as JSON text, derived from the in-build columns of every build (of ``rows``, where they are written)."""
    cols = scoring.REQUEST_COLUMNS
    rows = _b(spark, sf_dir, ["Sample_ID"] + cols) if rows is None else rows
    return rows.select("Sample_ID", F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value"))


def _written_requests(spark, sf_dir, rows=None):
    """A folder of compressed request files: field names repeat in every record."""
    path = shared_path(spark, "requests")
    _requests(spark, sf_dir, rows).write.option("compression", "gzip").json(path)
    return path


def _flat_requests(df):
    return df.withColumn("missing_fields", F.array_join("missing_fields", ","))


def _scored_rows(spark, sf_dir):
    """What a saved model is trained on and scores: joined and written once for both."""
    return _written(spark, sf_dir, [*_ML_COLS, "event_time"])


def _saved_lr(spark, rows):
    res = ml.train_model(rows, "inbuild", "logistic_regression")
    path = shared_path(spark, "model-inbuild-lr")
    ml.save_model(res["model"], res["metadata"], path)
    return ml.load_model(spark, path)


def _score_batch(spark, sf_dir):
    rows = _scored_rows(spark, sf_dir)
    return scoring.score_with(*_saved_lr(spark, rows))(scoring.parse_requests(_requests(spark, sf_dir, rows)))


def _evaluate_saved(spark, sf_dir):
    rows = _training_rows(spark, sf_dir)
    return ml.evaluate_saved(*_saved_lr(spark, rows), rows)


def _model_save_load(spark, sf_dir):
    """Every type of model saved and reloaded, on the in-build columns: rows scored by both, and those that differ."""
    ready = ml.prepare(_training_rows(spark, sf_dir), "inbuild")
    raw = _b(spark, sf_dir, ["Sample_ID", *ready.features])
    parts = []
    for m in ml.MODEL_TYPES:
        res = ml.train_model(None, "inbuild", m, prepared=ready, params=SAVED_SIZES.get(m))
        path = shared_path(spark, f"model-{m}")
        ml.save_model(res["model"], res["metadata"], path)
        model, meta = ml.load_model(spark, path)
        first = res["model"].transform(raw).select(*raw.columns, F.col("prediction").alias("first"))
        parts.append(model.transform(first).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("first") != F.col("prediction")).alias("differing")).select(
            F.lit(meta["scenario"]).alias("scenario"), F.lit(meta["model_type"]).alias("model_type"),
            F.lit(len(model.stages)).alias("stages"), F.lit(meta["n_rows_train"]).alias("n_rows_train"),
            F.lit(len(meta["features"])).alias("features"), "rows", "differing"))
    return reduce(DataFrame.unionByName, parts)


def _preprocess(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    df = ml.with_class_weights(_written(spark, sf_dir, ["Sample_ID"] + ml.scenario_columns("prebuild") + [TARGET]))
    pipe = ml.build_pipeline(df, ml.scenario_columns("prebuild"), "logistic_regression", 1.0)
    prep = type(pipe)(stages=pipe.getStages()[:-1]).fit(df)
    return prep.transform(df).select("Sample_ID", "label", vector_to_array("features").alias("features"))


CSV_FILE_ROWS = 1_000_000


def _scan_csv(spark, sf_dir):
    path = shared_path(spark, "builds-csv")
    # text in files of bounded rows, as a compressed one is read by one task
    _b(spark, sf_dir).write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)
    return files.scan_csv_contract(spark, path).drop("_corrupt_record")


def _source_report(spark, sf_dir):
    path = shared_path(spark, "report-missing")
    files.sink_reports({"missing_values": quality.missing_values(_b(spark, sf_dir))}, path)
    return files.source_report(spark, f"{path}/missing_values",
                               "column string, missing_count long, missing_percent double, status string")


def _sink_reports(spark, sf_dir):
    df = _b(spark, sf_dir)
    path = shared_path(spark, "reports")
    reps = {"schema": quality.schema_report(df), "missing_values": quality.missing_values(df),
            "duplicates": quality.duplicate_rows(df), "physical_ranges": quality.physical_ranges(df)}
    paths = files.sink_reports(reps, path)
    parts = [spark.read.option("header", True).csv(p).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "report", F.lit(n)) for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sink_metrics_json(spark, sf_dir):
    path = shared_path(spark, "metrics-json")
    files.sink_metrics_json(evaluation.metrics_report(_pred(spark, sf_dir), keys=["scenario", "model_type"]), path)
    read = spark.read.json(path)
    return read.select("scenario", "model_type", *projections.METRIC_NAMES)


def _sink_confusion(spark, sf_dir):
    path = shared_path(spark, "confusion-csv")
    files.sink_confusion_csv(evaluation.confusion_matrix(_pred(spark, sf_dir), ["scenario", "model_type"]),
                             ["scenario", "model_type"], path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _run_audit(spark, sf_dir):
    df = _b(spark, sf_dir)
    gate = quality.quality_gate(quality.data_quality_bundle(df)).first()
    return files.run_audit(spark, shared_path(spark, "audit"), f"{sf_dir}/lineitem.parquet", df.count(),
                           len(df.columns), gate["status"], gate["fail_count"], gate["warn_count"], gate["message"]).drop("run_time", "input")


def _recommended_action(spark, sf_dir):
    pred = candidates.candidate_predictions(_b(spark, sf_dir, ["Sample_ID", TARGET] + candidates.RULE_COLUMNS))
    pred = pred.filter(F.col("model_type") == "rule_baseline").withColumn(
        "risk_probability", F.when(F.col("prediction") == "Good", F.lit(0.45)))
    return pred.select("scenario", F.col("prediction").alias("predicted_quality_class"), "risk_probability",
                       scoring.recommended_action("prediction", "risk_probability").alias("recommended_action")) \
        .groupBy("scenario", "predicted_quality_class", "recommended_action").agg(F.count(F.lit(1)).alias("rows"))


QUERIES.update({
    "train_model": lambda s, d: _metrics(s, d, "inbuild", "logistic_regression"),
    "model_logistic": lambda s, d: _metrics(s, d, "prebuild", "logistic_regression"),
    "model_forest": lambda s, d: _metrics(s, d, "inbuild", "random_forest"),
    "model_boosting": lambda s, d: _metrics(s, d, "inbuild", "hist_gradient_boosting"),
    "training_grid": lambda s, d: _training_grid(s, d),
    "ladder_comparison": lambda s, d: selection.compare_models(_ladder(s, d)),
    "ladder_selection": _ladder_selection,
    "preprocess": _preprocess,
    "quick_predictability": lambda s, d: ml.quick_predictability(_written(s, d)),
    "evaluate_saved": _evaluate_saved,
    "model_save_load": _model_save_load,
    "score_batch": _score_batch,
    "score_rejects": lambda s, d: _flat_requests(scoring.reject_rows(scoring.parse_requests(_requests(s, d)))),
    "scoring_frame": lambda s, d: _flat_requests(scoring.scoring_frame(_b(s, d, ["Sample_ID"] + scoring.REQUEST_COLUMNS))),
    "source_scoring_json": lambda s, d: _flat_requests(scoring.parse_requests(_requests(s, d))),
    "recommended_action": _recommended_action,
    "scan_csv_contract": _scan_csv,
    "source_report": _source_report,
    "sink_reports": _sink_reports,
    "sink_metrics_json": _sink_metrics_json,
    "sink_confusion_csv": _sink_confusion,
    "run_audit": _run_audit,
})


# ---------------------------------------------------------------------------
# monitoring (batch twins) and streams
# ---------------------------------------------------------------------------

from fusionlens.streaming import monitoring  # noqa: E402

_MON = ["Sample_ID", "event_time", "machine_id", TARGET, "Porosity_percent", "Relative_Density_percent",
        "Defect_Count", "Energy_Density_J_mm3", "Melt_Pool_Depth_um"] + monitoring.DRIFT_FEATURES


def _mon(spark, sf_dir):
    return _b(spark, sf_dir, list(dict.fromkeys(_MON)))


def _rule_scored(spark, sf_dir):
    return _mon(spark, sf_dir).withColumn("predicted_quality_class", F.expr(monitoring.INBUILD_RULE))


def _model_scored(spark, sf_dir):
    """Every build with the class and the risk probability of the saved in-build model."""
    rows = _scored_rows(spark, sf_dir)
    cols = ["Sample_ID", "event_time", *scoring.REQUEST_COLUMNS]
    return scoring.score_with(*_saved_lr(spark, rows))(scoring.scoring_frame(rows.select(cols)))


def _stream_scoring(spark, sf_dir):
    rows = _scored_rows(spark, sf_dir)
    req_dir = _written_requests(spark, sf_dir, rows)
    valid, reject = shared_path(spark, "scored"), shared_path(spark, "rejected")
    q = monitoring.stream_scoring(spark, req_dir, valid, reject, shared_path(spark, "ckpt-scoring"),
                                  scoring.score_with(*_saved_lr(spark, rows)))
    q.awaitTermination()
    return spark.read.parquet(valid).drop("epoch_id")


def _stream_quality(spark, sf_dir):
    src = shared_path(spark, "builds-stream-src")
    _mon(spark, sf_dir).write.parquet(src)
    sink = shared_path(spark, "drift-stream")
    schema = spark.read.parquet(src).schema
    q = monitoring.stream_quality_drift(spark, src, schema, sink, shared_path(spark, "ckpt-drift"))
    q.awaitTermination()
    return monitoring.newest_epoch(spark, sink)


def _stream_windows(spark, rows, aggregates):
    src = shared_path(spark, "windows-stream-src")
    rows.write.option("compression", "zstd").parquet(src)
    sink = shared_path(spark, "windows-stream")
    monitoring.stream_window_table(spark, src, rows.schema, sink, shared_path(spark, "ckpt-windows"), aggregates).awaitTermination()
    return monitoring.newest_epoch(spark, sink)


def _stream_process_drift(spark, sf_dir):
    """Every build as a stream, held against version 1 of a baseline frozen from the whole table."""
    src, sink, base = shared_path(spark, "process-stream-src"), shared_path(spark, "process-stream"), shared_path(spark, "baseline")
    rows = _mon(spark, sf_dir)
    rows.write.parquet(src)
    monitoring.freeze_baseline(monitoring.drift_baseline(spark.read.parquet(src)), base, 1)
    monitoring.stream_process_drift(spark, src, rows.schema, sink, shared_path(spark, "ckpt-process"), base, 1).awaitTermination()
    return monitoring.newest_epoch(spark, sink)


QUERIES.update({
    "quality_drift_window": lambda s, d: monitoring.quality_drift_window(_mon(s, d)),
    "inspection_drift_window": lambda s, d: monitoring.inspection_drift_window(_mon(s, d)),
    "process_drift_psi": lambda s, d: monitoring.process_drift_psi(_mon(s, d)),
    "prediction_mix_drift": lambda s, d: monitoring.prediction_mix_drift(
        _model_scored(s, d), prob_col="class_probabilities", risk_col="risk_probability"),
    "prediction_mix_drift_rule": lambda s, d: monitoring.prediction_mix_drift(_rule_scored(s, d)),
    "drift_alerts": lambda s, d: _alerts(s, d),
    "rolling_sensor_stats": lambda s, d: monitoring.rolling_sensor_stats(_mon(s, d)),
    "physics_features": lambda s, d: monitoring.physics_features(_b(s, d)).select(
        "Sample_ID", "energy_density_calc", "power_speed_ratio", "linear_heat_input_J_mm", "melt_pool_aspect_ratio",
        "cooling_to_gradient_ratio", "strategy_power_window"),
    "stream_scoring": _stream_scoring,
    "quality_drift_stream": _stream_quality,
    "process_drift_stream": _stream_process_drift,
    "inspection_drift_stream": lambda s, d: _stream_windows(s, _mon(s, d), monitoring.inspection_means()),
    "prediction_mix_rule_stream": lambda s, d: _stream_windows(s, _rule_scored(s, d), monitoring.prediction_mix()),
    "prediction_mix_stream": lambda s, d: _stream_windows(
        s, _model_scored(s, d), monitoring.prediction_mix(prob_col="class_probabilities", risk_col="risk_probability")),
})


def _training_pipeline(spark, sf_dir):
    """Fit preprocessing + classifier as one Pipeline; one row per fitted stage."""
    df = ml.with_class_weights(_written(spark, sf_dir, ["Sample_ID"] + ml.scenario_columns("postbuild") + [TARGET]))
    model = ml.build_pipeline(df, ml.scenario_columns("postbuild"), "logistic_regression", 1.0).fit(df)
    rows = [(i, type(st).__name__) for i, st in enumerate(model.stages)]
    width = len(model.stages[-1].coefficientMatrix.toArray()[0])
    return spark.createDataFrame(rows, "stage int, stage_type string").withColumn("feature_vector_size", F.lit(width))


def _selection_policy(spark, sf_dir):
    counts = _cmp(spark, sf_dir).groupBy("scenario").agg(F.count(F.lit(1)).alias("candidates"))
    return counts.join(selection.policy_table(spark), "scenario")


QUERIES.update({
    "correlation_matrix": lambda s, d: stats.correlation_matrix(_b(s, d)),
    "dataset_overview": lambda s, d: summary.dataset_overview(_b(s, d)),
    "training_pipeline": _training_pipeline,
    "selection_policy": _selection_policy,
})


def _alerts(spark, sf_dir):
    m = _mon(spark, sf_dir)
    return monitoring.drift_alerts(monitoring.quality_drift_window(m), monitoring.process_drift_psi(m),
                                   candidates.CHECK_RISK_DELTA, candidates.CHECK_PSI)


def _debounce_stream(spark, sf_dir):
    src = shared_path(spark, "alerts")
    _alerts(spark, sf_dir).write.parquet(src)
    out = shared_path(spark, "alerts-confirmed")
    q = monitoring.stream_debounce_alerts(spark, src, out, shared_path(spark, "ckpt-debounce"))
    q.awaitTermination()
    return spark.read.schema(monitoring.DEBOUNCE_OUT).parquet(out)


QUERIES.update({
    "alert_debounce": lambda s, d: monitoring.debounce_alerts(_alerts(s, d)),
    "alert_debounce_stream": _debounce_stream,
})
