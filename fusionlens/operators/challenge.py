"""Level-3 realism challenges: uniformity, physics correlations, energy formula,
class separation (Kruskal-Wallis), defect trend, leakage and the scorecard."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusionlens.contract import (
    IDENTIFIER_COLUMNS, PHYSICS_PAIRS, POST_BUILD, QUALITY_ORDER, TARGET, TEXT, THRESHOLDS,
    usable_numeric_columns,
)
from fusionlens.functions.exprs import energy_density, guarded_corr, quality_ordinal
from fusionlens.operators import ranks
from fusionlens.operators.order_stats import class_value_counts, quantile_table
from fusionlens.operators.binned import histogram
from fusionlens.operators.stats import long_numeric

def uniformity_scores(df: DataFrame, columns: list[str], bins: int = THRESHOLDS["uniformity_bins"]) -> DataFrame:
    """Entropy of a ``bins``-bin histogram / ln(non-empty bins); 0 for <= 1 distinct value or bin."""
    h = histogram(df, columns, bins).filter(F.col("count") > 0)
    tot = h.groupBy("feature").agg(F.sum("count").alias("__n"), F.count(F.lit(1)).alias("nonempty_bins"))
    p = F.col("count") / F.col("__n")
    ent = h.join(tot, "feature").groupBy("feature", "nonempty_bins").agg((-F.sum(p * F.log(p))).alias("entropy"))
    return ent.select(
        "feature", "nonempty_bins",
        F.when(F.col("nonempty_bins") <= 1, F.lit(0.0))
        .otherwise(F.col("entropy") / F.log(F.col("nonempty_bins").cast("double"))).alias("uniformity_score"))


def distribution_challenge(df: DataFrame) -> DataFrame:
    """Per safe numeric feature: min, max, mean, std, distinct, uniformity; sorted desc."""
    cols = usable_numeric_columns(df)
    long = long_numeric(df, cols).filter(F.col("value").isNotNull())
    basic = long.groupBy("feature").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.count_distinct("value").alias("unique_values"))
    uni = uniformity_scores(df, cols)
    out = basic.join(uni, "feature", "left").select(
        "feature", "min", "max", "mean", "std", "unique_values",
        F.when(F.col("unique_values") <= 1, F.lit(0.0)).otherwise(F.coalesce("uniformity_score", F.lit(0.0)))
        .alias("uniformity_score"))
    return out.withColumn(
        "interpretation",
        F.when(F.col("uniformity_score") >= THRESHOLDS["uniform"], TEXT["uniform_yes"]).otherwise(TEXT["uniform_no"]),
    ).orderBy(F.desc("uniformity_score"), "feature")


def physics_correlations(df: DataFrame) -> DataFrame:
    """Pearson for the listed physics pairs (class as its ordinal), abs, weak below 0.10."""
    work = df.withColumn("Quality_Class_numeric", quality_ordinal(TARGET)) if TARGET in df.columns else df
    pairs = []
    for left, right, expect in PHYSICS_PAIRS:
        rc = "Quality_Class_numeric" if right == TARGET else right
        if left in work.columns and rc in work.columns:
            pairs.append((left, right, rc, expect))
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], "relationship string, correlation double, absolute_correlation double, "
                                         "expected_physics string, interpretation string")
    names = [f"p{i}" for i in range(len(pairs))]
    wide = work.agg(*[guarded_corr(F.col(l).cast("double"), F.col(rc).cast("double")).alias(n)
                      for n, (l, _, rc, _) in zip(names, pairs)])
    meta = spark.createDataFrame([(n, f"{l} vs {r}", e) for n, (l, r, _, e) in zip(names, pairs)],
                                 "pair string, relationship string, expected_physics string")
    long = wide.unpivot([], names, "pair", "correlation").join(F.broadcast(meta), "pair")
    weak = F.abs("correlation") < THRESHOLDS["weak_correlation"]
    return long.select(
        "relationship", "correlation", F.abs("correlation").alias("absolute_correlation"), "expected_physics",
        F.when(F.col("correlation").isNull(), TEXT["not_computable"]).when(weak, TEXT["weak_pair"])
        .otherwise(TEXT["visible_pair"]).alias("interpretation"),
    ).orderBy(F.desc_nulls_last("absolute_correlation"), "relationship")


ENERGY_REQUIRED = ["Laser_Power_W", "Scan_Speed_mm_s", "Hatch_Spacing_mm", "Layer_Thickness_um", "Energy_Density_J_mm3"]
ENERGY_SCHEMA = ("check string, status string, reason string, rows_checked long, "
                 "correlation_observed_vs_calculated double, mean_absolute_error double, "
                 "mean_absolute_percent_error double, interpretation string")


def energy_formula_check(df: DataFrame) -> DataFrame:
    """Observed vs P/(v h t) on complete rows: correlation, MAE, MAPE; PASS at corr >= 0.95.

    MAPE skips rows with a zero observed value (instead of an infinite mean).
    """
    spark = df.sparkSession
    if not set(ENERGY_REQUIRED).issubset(df.columns):
        return spark.createDataFrame([("energy_density_formula", "SKIPPED", TEXT["energy_missing_cols"],
                                       None, None, None, None, None)], ENERGY_SCHEMA)
    work = df.select(*ENERGY_REQUIRED).na.drop("any")
    obs, calc = F.col("Energy_Density_J_mm3"), energy_density()
    agg = work.select(obs.alias("o"), calc.alias("c")).agg(
        F.count(F.lit(1)).alias("rows_checked"),
        guarded_corr("o", "c").alias("corr"),
        F.avg(F.abs(F.col("o") - F.col("c"))).alias("mae"),
        (F.avg(F.abs(F.try_divide(F.col("o") - F.col("c"), F.col("o")))) * F.lit(100.0)).alias("mape"),
    )
    ok = F.col("corr") >= THRESHOLDS["energy_formula_corr"]
    empty = F.col("rows_checked") == 0
    return agg.select(
        F.lit("energy_density_formula").alias("check"),
        F.when(empty, "SKIPPED").when(ok, "PASS").otherwise("WARN").alias("status"),
        F.when(empty, TEXT["energy_no_rows"]).alias("reason"),
        F.col("rows_checked").cast("long").alias("rows_checked"),
        F.col("corr").alias("correlation_observed_vs_calculated"),
        F.col("mae").alias("mean_absolute_error"),
        F.col("mape").alias("mean_absolute_percent_error"),
        F.when(empty, F.lit(None)).when(ok, TEXT["energy_pass"]).otherwise(TEXT["energy_warn"]).alias("interpretation"),
    )


def kruskal_statistics(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Kruskal-Wallis H (tie-corrected) per safe numeric feature over class groups.

    Average ranks come from the distinct-value cumulative counts
    (``ranks.cumulative``): avg rank = below + (t+1)/2 for a value seen t
    times, so no task ever sorts a whole feature. Features whose values are
    all identical, or with fewer than two non-empty groups, are left out.
    Returns (feature, kruskal_statistic, degrees_of_freedom).
    """
    cols = usable_numeric_columns(df)
    # both count tables are read by several branches: each is computed and written once
    per_class = ranks.staged(class_value_counts(df, cols, TARGET))
    per_value = ranks.staged(per_class.groupBy("feature", "value").agg(F.sum("cj").alias("cnt")))
    cum = ranks.average_ranks(ranks.cumulative(per_value, ["feature"], "value", buckets, staged_input=True))
    joined = per_class.join(cum.select("feature", "value", "avg_rank", "cnt", "n"), ["feature", "value"])
    groups = joined.groupBy("feature", TARGET).agg(
        F.sum(F.col("cj") * F.col("avg_rank")).alias("r"), F.sum("cj").alias("nj"), F.first("n").alias("n"))
    ties = per_value.groupBy("feature").agg(
        F.sum(F.col("cnt").cast("double") ** 3 - F.col("cnt")).alias("tie_sum"))
    per_feature = groups.groupBy("feature").agg(
        F.sum(F.col("r") * F.col("r") / F.col("nj")).alias("ssq"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("k"))
    nn = F.col("n").cast("double")
    corr_factor = F.lit(1.0) - F.col("tie_sum") / (nn ** 3 - nn)
    h = (F.lit(12.0) / (nn * (nn + 1)) * F.col("ssq") - F.lit(3.0) * (nn + 1)) / corr_factor
    return per_feature.join(ties, "feature").filter((F.col("k") >= 2) & (corr_factor > 0)).select(
        "feature", h.alias("kruskal_statistic"), (F.col("k") - 1).cast("int").alias("degrees_of_freedom"))


def kruskal_separation(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """H, degrees of freedom and p value per feature, smallest p first; weak from the 5 % level on.

    The tail probability is a small Arrow-batched function over one row per
    feature (Spark has no chi-square tail).
    """
    from fusionlens.functions.udfs import chi2_sf_udf

    st = kruskal_statistics(df, buckets).withColumn("p_value", chi2_sf_udf("kruskal_statistic", "degrees_of_freedom"))
    weak = F.col("p_value") >= THRESHOLDS["kruskal_alpha"]
    return st.withColumn("class_separation_signal", F.when(weak, TEXT["sep_weak"]).otherwise(TEXT["sep_yes"])) \
        .orderBy("p_value", "feature")


def chi2_survival(h: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (integer dof), closed form."""
    if h is None or dof is None or dof < 1 or h != h:
        return float("nan")
    if h <= 0:
        return 1.0
    x = h / 2.0
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= x / i
            total += term
        return math.exp(-x) * total
    total = math.erfc(math.sqrt(x))
    term = math.sqrt(x) * math.exp(-x) * 2.0 / math.sqrt(math.pi)
    for i in range(1, (dof + 1) // 2):
        total += term
        term *= x / (i + 0.5)
    return min(1.0, max(0.0, total))


def defect_trend(df: DataFrame) -> DataFrame:
    """Count, mean, median, std of Defect_Count per class in quality order; PASS if means never rise."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(v, i) for i, v in enumerate(QUALITY_ORDER)], f"{TARGET} string, __order int")
    base = df.select(TARGET, F.col("Defect_Count").cast("double").alias("value")).filter(F.col(TARGET).isNotNull())
    stats_ = base.groupBy(TARGET).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    med = quantile_table(base, ["value"], {"median": 0.5}, by=TARGET).drop("feature", "n")
    table = domain.join(stats_, TARGET, "left").join(med, TARGET, "left")
    # the trend ignores classes without data (their mean is NULL): compare with the last non-NULL mean
    last_mean = F.last("mean", ignorenulls=True).over(
        Window.orderBy("__order").rowsBetween(Window.unboundedPreceding, -1))
    flagged = table.withColumn("__rise", F.when(F.col("mean") > last_mean, 1).otherwise(0))
    any_rise = F.max("__rise").over(Window.partitionBy(F.lit(1)))
    return flagged.select(
        TARGET, F.col("count").cast("long").alias("count"), "mean", "median", "std",
        F.when(any_rise > 0, TEXT["trend_warn"]).otherwise(TEXT["trend_pass"]).alias("trend_check"),
        "__order",
    ).orderBy("__order").drop("__order")


def leakage_identifiers(df: DataFrame) -> DataFrame:
    rows = []
    for c in df.columns:
        if c in IDENTIFIER_COLUMNS:
            rows.append((c, TEXT["id_leak"], TEXT["id_rec"]))
        if c in POST_BUILD:
            rows.append((c, TEXT["timing_leak"], TEXT["timing_rec"]))
    return df.sparkSession.createDataFrame(rows, "feature string, risk_type string, recommendation string")


def challenge_reports(df: DataFrame, include_model: bool = False) -> dict[str, DataFrame]:
    reports = {
        "distribution_challenge": distribution_challenge(df),
        "physics_correlation_challenge": physics_correlations(df),
        "energy_density_formula_challenge": energy_formula_check(df),
        "quality_separation_challenge": kruskal_separation(df),
        "defect_trend_challenge": defect_trend(df),
        "leakage_challenge": leakage_identifiers(df),
    }
    if include_model:
        from fusionlens.operators.ml import quick_predictability
        reports["quick_model_predictability_challenge"] = quick_predictability(df)
    return reports


def challenge_bundle(reports: dict[str, DataFrame]) -> DataFrame:
    """The challenges as one long table (report, item, value, label); the model's only if it is among the reports."""
    r = reports

    def part(name, frame, item, value, label):
        return frame.select(F.lit(name).alias("report"), F.col(item).cast("string").alias("item"),
                            (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"),
                            F.col(label).cast("string").alias("label"))
    model = r.get("quick_model_predictability_challenge")
    return reduce(lambda a, b: a.unionByName(b), [
        *([part("quick_model_predictability_challenge", model, "check", "balanced_accuracy", "interpretation")] if model else []),
        part("distribution_challenge", r["distribution_challenge"], "feature", "uniformity_score", "interpretation"),
        part("physics_correlation_challenge", r["physics_correlation_challenge"], "relationship", "correlation",
             "interpretation"),
        part("energy_density_formula_challenge", r["energy_density_formula_challenge"], "check",
             "correlation_observed_vs_calculated", "status"),
        part("quality_separation_challenge", r["quality_separation_challenge"], "feature", "kruskal_statistic",
             "class_separation_signal"),
        part("defect_trend_challenge", r["defect_trend_challenge"], TARGET, "mean", "trend_check"),
        part("leakage_challenge", r["leakage_challenge"], "feature", None, "risk_type"),
    ])


def realism_scorecard(reports: dict[str, DataFrame]) -> DataFrame:
    """One row per challenge with its headline count (model row N/A without a model report)."""
    dist = reports["distribution_challenge"].agg(
        F.count_if(F.col("uniformity_score") >= THRESHOLDS["uniform"]).alias("u")).select(
        F.lit(1).alias("__pos"), F.lit("Distribution realism").alias("challenge"),
        F.format_string("%d highly uniform variables", "u").alias("result"))
    energy = reports["energy_density_formula_challenge"].select(
        F.lit(2).alias("__pos"), F.lit("Energy-density formula").alias("challenge"),
        F.when(F.col("correlation_observed_vs_calculated").isNull(), "N/A").otherwise(
            F.format_string("corr=%.3f, MAPE=%.1f%%", "correlation_observed_vs_calculated",
                            "mean_absolute_percent_error")).alias("result"))
    phys = reports["physics_correlation_challenge"].agg(
        F.count_if(F.col("absolute_correlation") < THRESHOLDS["weak_correlation"]).alias("w"),
        F.count(F.lit(1)).alias("n")).select(
        F.lit(3).alias("__pos"), F.lit("Expected physics correlations").alias("challenge"),
        F.format_string("%d/%d weak", "w", "n").alias("result"))
    sep = reports["quality_separation_challenge"].agg(
        F.count_if(F.col("class_separation_signal") == TEXT["sep_weak"]).alias("w"),
        F.count(F.lit(1)).alias("n")).select(
        F.lit(4).alias("__pos"), F.lit("Quality class separation").alias("challenge"),
        F.format_string("%d/%d weak", "w", "n").alias("result"))
    if "quick_model_predictability_challenge" in reports:
        model = reports["quick_model_predictability_challenge"].select(
            F.lit(5).alias("__pos"), F.lit("Quick RF predictability").alias("challenge"),
            F.when(F.col("balanced_accuracy").isNull(), "N/A").otherwise(F.format_string(
                "balanced acc=%.3f (random=%.3f)", "balanced_accuracy", "random_chance_baseline")).alias("result"))
    else:
        model = dist.select(F.lit(5).alias("__pos"), F.lit("Quick RF predictability").alias("challenge"),
                            F.lit("N/A").alias("result"))
    leak = reports["leakage_challenge"].agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(6).alias("__pos"), F.lit("Timing / identifier leakage").alias("challenge"),
        F.format_string("%d columns flagged", "n").alias("result"))
    return reduce(lambda a, b: a.unionByName(b), [dist, energy, phys, sep, model, leak]).orderBy("__pos").drop("__pos")
