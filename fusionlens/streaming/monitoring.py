"""Production monitoring over time: windowed drift tables, alerts, rolling sensor stats.

The drift tables are batch DataFrame functions: tumbling ``window(event_time,
...)`` groups with partial aggregation, the baseline a small aggregate joined
back. Quality, inspection, process and prediction drift, scoring and the debounced alerts also
have stream forms below, which give the batch results; the other tables run per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusionlens.contract import QUALITY_ORDER, TARGET, scenario_columns
from fusionlens.functions.exprs import edge_bin, nan_to_null, risk_flag
from fusionlens.functions.frames import attach_one_row
from fusionlens.operators.rolling import PART_ROWS, rolling_stats

WINDOW = "30 days"
DRIFT_FEATURES = ["Laser_Power_W", "Scan_Speed_mm_s", "Melt_Pool_Temp_C", "Thermal_Gradient"]
PSI_BINS = 10
PSI_FLOOR = 1e-6
RISK_DELTA_ALERT = 5.0  # percentage points
PSI_ALERT = 0.2


def _event_ts(c: str = "event_time"):
    return F.col(c).cast("timestamp")


def _windowed(df: DataFrame, window: str):
    w = F.window(_event_ts(), window)
    return df.withColumn("__w", w).withColumn("window_start", F.col("__w.start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("__w.end").cast("timestamp_ntz")).drop("__w")


def quality_drift_window(df: DataFrame, window: str = WINDOW, baseline: DataFrame | None = None) -> DataFrame:
    """Poor+Moderate rate per tumbling window vs the baseline rate (whole table by default)."""
    base = (baseline if baseline is not None else df).filter(F.col(TARGET).isNotNull()).agg(
        (F.lit(100.0) * F.sum(risk_flag()) / F.count(F.lit(1))).alias("baseline_risk_rate_percent"))
    w = _windowed(df.filter(F.col(TARGET).isNotNull()), window).groupBy("window_start", "window_end").agg(
        F.count(F.lit(1)).alias("samples"), (F.lit(100.0) * F.sum(risk_flag()) / F.count(F.lit(1))).alias(
            "risk_rate_percent"))
    return attach_one_row(w, base).withColumn(
        "delta_percent_points", F.col("risk_rate_percent") - F.col("baseline_risk_rate_percent"))


def inspection_drift_window(df: DataFrame, window: str = WINDOW) -> DataFrame:
    """Means of porosity, relative density and defect count per window."""
    return _windowed(df, window).groupBy("window_start", "window_end").agg(*inspection_means())


def inspection_means() -> list[Column]:
    return [F.count(F.lit(1)).alias("samples"),
            F.avg(nan_to_null("Porosity_percent")).alias("mean_porosity_percent"),
            F.avg(nan_to_null("Relative_Density_percent")).alias("mean_relative_density_percent"),
            F.avg(nan_to_null("Defect_Count")).alias("mean_defect_count")]


def _feature_values(df: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    return df.select(*keep, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in features]).unpivot(
        keep, features, "feature", "value").filter(F.col("value").isNotNull())


def _with_bins(long: DataFrame, ranges: DataFrame, bins: int) -> DataFrame:
    # one row per drift feature: bounded by the feature list
    return long.join(F.broadcast(ranges), "feature").withColumn("bin", edge_bin("value", "lo", "hi", bins, right_closed=False))


def drift_baseline(df: DataFrame, features: list[str] = DRIFT_FEATURES, bins: int = PSI_BINS) -> DataFrame:
    """(feature, lo, hi, bin, share): range and share of each of ``bins`` equal-width left-closed bins; empty bins hold 0."""
    long = _feature_values(df, [], features)
    ranges = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    counts = _with_bins(long, ranges, bins).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("__c"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    n = F.sum("__c").over(Window.partitionBy("feature"))  # ``bins`` rows a feature
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "lo", "hi", "bin", (F.coalesce(F.col("__c"), F.lit(0)) / n).alias("share"))


def freeze_baseline(baseline: DataFrame, table_dir: str, version: int) -> None:
    """Write a baseline as ``baseline_version=<n>`` of a table; a version that exists is an error, never replaced."""
    baseline.coalesce(1).write.parquet(f"{table_dir}/baseline_version={version}")


def frozen_baseline(spark: SparkSession, table_dir: str, version: int) -> DataFrame:
    """One version of the table, with its ``baseline_version``."""
    return spark.read.option("basePath", table_dir).parquet(f"{table_dir}/baseline_version={version}")


def _psi(counts: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """PSI per ``keys`` and feature from (keys, feature, bin, __c) counts; absent bins count 0, shares are floored."""
    totals = counts.groupBy(*keys, "feature").agg(F.sum("__c").alias("__n"))
    # the baseline has one row per drift feature and bin (and version): bounded by the feature list
    on = [k for k in ("baseline_version", "feature") if k in (*keys, "feature")]
    full = totals.join(F.broadcast(baseline.select(*on, "bin", "share")), on).join(
        counts, [*keys, "feature", "bin"], "left")
    a = F.greatest(F.coalesce(F.col("__c"), F.lit(0)) / F.col("__n"), F.lit(PSI_FLOOR))
    b = F.greatest(F.col("share"), F.lit(PSI_FLOOR))
    return full.groupBy(*keys, "feature").agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def process_drift_psi(df: DataFrame, window: str = WINDOW, features: list[str] = DRIFT_FEATURES,
                      bins: int = PSI_BINS, baseline: DataFrame | None = None) -> DataFrame:
    """Population stability index per window and feature against baseline bin shares.

    Bins: ``bins`` equal-width left-closed bins on the baseline range (values
    outside fall in the end bins). Shares are floored at 1e-6 so empty bins
    stay finite: PSI = sum (a - b) ln(a / b). ``baseline`` holds rows like ``df``.
    """
    base = drift_baseline(baseline if baseline is not None else df, features, bins)
    ranges = base.select("feature", "lo", "hi").distinct()
    long = _feature_values(_windowed(df, window), ["window_start"], features)
    counts = _with_bins(long, ranges, bins).groupBy("window_start", "feature", "bin").agg(F.count(F.lit(1)).alias("__c"))
    return _psi(counts, base, ["window_start"])


INBUILD_RULE = ("CASE WHEN Energy_Density_J_mm3 >= 90 THEN 'Poor' WHEN Melt_Pool_Depth_um >= 70 THEN 'Moderate' "
                "ELSE 'Good' END")


def prediction_mix_drift(scored: DataFrame, window: str = WINDOW, pred_col: str = "predicted_quality_class",
                         prob_col: str | None = None, risk_col: str | None = None) -> DataFrame:
    """Share of each predicted class per window; with a map of class probabilities the mean confidence, and the mean risk."""
    return _windowed(scored, window).groupBy("window_start", "window_end").agg(*prediction_mix(pred_col, prob_col, risk_col))


def prediction_mix(pred_col: str = "predicted_quality_class", prob_col: str | None = None,
                   risk_col: str | None = None) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("samples")]
    aggs += [(F.count_if(F.col(pred_col) == q) / F.count(F.lit(1))).alias(f"share_{q}") for q in QUALITY_ORDER]
    if prob_col:
        aggs.append(F.avg(F.array_max(F.map_values(prob_col))).alias("mean_confidence"))
    if risk_col:
        aggs.append(F.avg(risk_col).alias("mean_risk_probability"))
    return aggs


def drift_alerts(quality_drift: DataFrame, psi: DataFrame, risk_delta: float = RISK_DELTA_ALERT,
                 psi_limit: float = PSI_ALERT) -> DataFrame:
    """Alert rows from the drift tables."""
    q = quality_drift.filter(F.abs("delta_percent_points") > risk_delta).select(
        "window_start", F.lit("quality_risk_rate").alias("signal"), F.col("delta_percent_points").alias("value"),
        F.lit(risk_delta).alias("threshold"))
    p = psi.filter(F.col("psi") > psi_limit).select(
        "window_start", F.concat(F.lit("psi:"), F.col("feature")).alias("signal"), F.col("psi").alias("value"),
        F.lit(psi_limit).alias("threshold"))
    return q.unionByName(p)


def rolling_sensor_stats(df: DataFrame, signal: str = "Melt_Pool_Temp_C", key: str = "machine_id",
                         days: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """``rolling_stats`` of a machine's signal over the ``days`` before each reading."""
    return rolling_stats(df, signal, key, days, part_rows)


def physics_features(df: DataFrame) -> DataFrame:
    """Derived physics columns (all divisions guarded)."""
    return df.select(
        "*",
        F.try_divide(F.col("Laser_Power_W"), F.col("Scan_Speed_mm_s") * F.col("Hatch_Spacing_mm")
                     * (F.col("Layer_Thickness_um") / 1000.0)).alias("energy_density_calc"),
        F.try_divide(F.col("Laser_Power_W"), F.col("Scan_Speed_mm_s")).alias("power_speed_ratio"),
        F.try_divide(F.col("Laser_Power_W"), F.col("Scan_Speed_mm_s")).alias("linear_heat_input_J_mm"),
        F.try_divide(F.col("Melt_Pool_Depth_um"), F.col("Melt_Pool_Width_um")).alias("melt_pool_aspect_ratio"),
        F.try_divide(F.col("Cooling_Rate_K_s"), F.col("Thermal_Gradient")).alias("cooling_to_gradient_ratio"),
        F.concat_ws("|", F.col("Scan_Strategy"), (F.floor(F.col("Laser_Power_W") / 50) * 50).cast("string"))
        .alias("strategy_power_window"),
    )


# ---------------------------------------------------------------------------
# Structured Streaming entry points
# ---------------------------------------------------------------------------

def stream_quality_drift(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str,
                         checkpoint_dir: str, window: str = WINDOW, baseline: DataFrame | None = None):
    """``quality_drift_window`` over a stream of build rows: every window, the newest too.

    The state is one row of counts per window. Each micro-batch writes the
    small result table from that state into a folder of its own (read the last with
    ``newest_epoch``). The baseline rate is that of ``baseline``, or of all rows so far.
    """
    src = spark.readStream.schema(schema).parquet(source_dir).filter(F.col(TARGET).isNotNull())
    counts = src.groupBy(F.window(_event_ts(), window).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(risk_flag()).alias("risk_count"))

    def finish(windows: DataFrame) -> DataFrame:
        rate = lambda risk, n: F.lit(100.0) * risk / n
        rows = windows.select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "samples", rate(F.col("risk_count"), F.col("samples")).alias("risk_rate_percent"))
        if baseline is None:
            base = windows.agg(rate(F.sum("risk_count"), F.sum("samples")).alias("baseline_risk_rate_percent"))
        else:
            base = baseline.filter(F.col(TARGET).isNotNull()).agg(
                rate(F.sum(risk_flag()), F.count(F.lit(1))).alias("baseline_risk_rate_percent"))
        return attach_one_row(rows, base).withColumn(
            "delta_percent_points", F.col("risk_rate_percent") - F.col("baseline_risk_rate_percent"))

    return _publish(counts, finish, sink_dir, checkpoint_dir)


def stream_window_table(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint_dir: str,
                        aggregates: list[Column], window: str = WINDOW):
    """One row per tumbling window of a stream of rows with ``event_time``: ``inspection_means()``, ``prediction_mix()``.

    The state is a partial aggregate per window, kept for all windows, so late rows count in theirs
    and the table equals the batch one. Rows without a time are left out.
    """
    src = spark.readStream.schema(schema).parquet(source_dir)
    table = src.groupBy(F.window(_event_ts(), window).alias("w")).agg(*aggregates)

    def finish(windows: DataFrame) -> DataFrame:
        return windows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                              F.col("w.end").cast("timestamp_ntz").alias("window_end"), *[c for c in windows.columns if c != "w"])

    return _publish(table, finish, sink_dir, checkpoint_dir)


def stream_process_drift(spark: SparkSession, source_dir: str, schema: T.StructType, sink_dir: str, checkpoint_dir: str,
                         baseline_dir: str, version: int, window: str = WINDOW):
    """``process_drift_psi`` over a stream, against version ``version`` of a frozen baseline table.

    The state is one count per window, feature and bin, kept for all windows, so late rows count in
    theirs. The version is part of the state's key: after a restart with another version, only the
    rows from then on are held against it and the earlier windows keep theirs. The number of
    bins and the features are the baseline's. Rows without a time or a value are left out.
    """
    tables = spark.read.parquet(baseline_dir)
    base = frozen_baseline(spark, baseline_dir, version)
    facts = base.groupBy("feature").agg(F.max("bin").alias("bins")).collect()  # one row per drift feature
    features, bins = sorted(r["feature"] for r in facts), max(r["bins"] for r in facts)
    src = spark.readStream.schema(schema).parquet(source_dir).withColumn("w", F.window(_event_ts(), window))
    long = _feature_values(src, ["w"], features)
    # the version comes as a column of the table: a literal would be folded out of the state's key
    ranges = base.select("baseline_version", "feature", "lo", "hi").distinct()
    counts = _with_bins(long, ranges, bins).groupBy("w", "baseline_version", "feature", "bin").agg(F.count(F.lit(1)).alias("__c"))

    def finish(state: DataFrame) -> DataFrame:
        rows = state.withColumn("window_start", F.col("w.start").cast("timestamp_ntz")).drop("w")
        return _psi(rows, tables, ["window_start", "baseline_version"])

    return _publish(counts, finish, sink_dir, checkpoint_dir)


def _publish(windows: DataFrame, finish, sink_dir: str, checkpoint_dir: str):
    """Each micro-batch writes its whole table as ``epoch_id=<n>``; one that runs again replaces its own folder only."""
    def write(batch: DataFrame, epoch_id: int):
        finish(batch).write.mode("overwrite").parquet(f"{sink_dir}/epoch_id={epoch_id}")

    return (windows.writeStream.outputMode("complete").foreachBatch(write)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def newest_epoch(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The table of the last finished micro-batch; files of an unfinished one are not seen."""
    epochs = spark.read.parquet(sink_dir)
    last = epochs.agg(F.max("epoch_id")).first()[0]
    return epochs.where(F.col("epoch_id") == F.lit(last)).drop("epoch_id")


def score_epoch(batch: DataFrame, epoch_id: int, valid_dir: str, reject_dir: str, score_fn) -> None:
    """Write a micro-batch's scored and rejected records into folders of its own: a batch that runs again replaces them."""
    from fusionlens.operators.scoring import parse_requests

    parsed = parse_requests(batch)
    for rows, folder in ((score_fn(parsed.filter(F.col("is_valid"))), valid_dir), (parsed.filter(~F.col("is_valid")), reject_dir)):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/epoch_id={epoch_id}")


def stream_scoring(spark: SparkSession, request_dir: str, valid_dir: str, reject_dir: str, checkpoint_dir: str,
                   score_fn):
    """Score JSON request files as a stream; bad records go to a reject table.

    ``score_fn(valid_df) -> DataFrame`` is any stateless scorer (a fitted
    pipeline's ``transform`` wrapped by ``scoring.score_batch``, or a rule).
    Both tables are partitioned by ``epoch_id``.
    """
    raw = spark.readStream.schema("Sample_ID long, value string").json(request_dir)
    return (raw.writeStream.foreachBatch(lambda batch, epoch: score_epoch(batch, epoch, valid_dir, reject_dir, score_fn))
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def rule_scorer(valid: DataFrame) -> DataFrame:
    """Stateless in-build rule scorer used by the stream smoke path."""
    from fusionlens.operators.scoring import recommended_action

    pred = valid.withColumn("predicted_quality_class", F.expr(INBUILD_RULE)).withColumn(
        "risk_probability", F.lit(None).cast("double"))
    return pred.withColumn("recommended_action", recommended_action()).select(
        "Sample_ID", *scenario_columns("inbuild"), "predicted_quality_class", "recommended_action")


# ---------------------------------------------------------------------------
# Debounced alerts: confirm a signal only after k consecutive windows
# ---------------------------------------------------------------------------

DEBOUNCE_WINDOWS = 2
WINDOW_SECONDS = 30 * 86400


def debounce_alerts(alerts: DataFrame, k: int = DEBOUNCE_WINDOWS, step_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Batch twin: one confirmed alert per run of >= k consecutive alert windows of a signal.

    Gaps-and-islands: within a signal, consecutive windows share
    ``window index - row number``; the k-th row of each island is emitted.
    The window is per signal over alert rows only (a handful per window).
    """
    idx = F.floor(_event_ts("window_start").cast("long") / F.lit(step_seconds))
    w = Window.partitionBy("signal").orderBy("window_start")
    a = alerts.withColumn("__idx", idx).withColumn("__island", F.col("__idx") - F.row_number().over(w))
    run = Window.partitionBy("signal", "__island").orderBy("window_start")
    return a.withColumn("run_length", F.row_number().over(run)).filter(F.col("run_length") == k).select(
        "window_start", "signal", "value", F.col("run_length").cast("int").alias("run_length"))


DEBOUNCE_OUT = T.StructType([
    T.StructField("window_start", T.TimestampNTZType()), T.StructField("signal", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("run_length", T.IntegerType())])
DEBOUNCE_STATE = T.StructType([T.StructField("last_index", T.LongType()), T.StructField("run", T.IntegerType())])


def _debounce_fn(k: int, step_seconds: int):
    def fn(key, batches, state):
        import pandas as pd

        last, run = (state.get if state.exists else (None, 0))
        out = []
        for pdf in batches:
            for row in pdf.sort_values("window_start").itertuples(index=False):
                idx = int(pd.Timestamp(row.window_start).value // 1_000_000_000 // step_seconds)
                if last is not None and idx == last:
                    continue  # same window seen again
                run = run + 1 if last is not None and idx == last + 1 else 1
                last = idx
                if run == k:
                    out.append((row.window_start, key[0], float(row.value), run))
        state.update((last, run))
        yield pd.DataFrame(out, columns=["window_start", "signal", "value", "run_length"])
    return fn


def stream_debounce_alerts(spark: SparkSession, alert_dir: str, sink_dir: str, checkpoint_dir: str,
                           k: int = DEBOUNCE_WINDOWS, step_seconds: int = WINDOW_SECONDS):
    """Stateful stream: per-signal run state (last window index, run length) kept by
    ``applyInPandasWithState``; alerts arrive in window order from an append-mode drift stream."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    src = spark.readStream.schema("window_start timestamp_ntz, signal string, value double, threshold double") \
        .parquet(alert_dir)
    out = src.groupBy("signal").applyInPandasWithState(
        _debounce_fn(k, step_seconds), DEBOUNCE_OUT, DEBOUNCE_STATE, "append", GroupStateTimeout.NoTimeout)
    return (out.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
