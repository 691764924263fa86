"""Projections and predicates: scenario views, model frames, derived flags.

All checks on column names run on the driver against ``df.columns`` (no job);
the projection itself is a ``select`` that Catalyst pushes into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.contract import (
    TARGET, scenario_columns, numeric_columns, usable_columns, policy_of, known_too_late,
)
from fusionlens.functions.exprs import energy_density, quality_ordinal, risk_flag


def _columns_in_time(scenario: str) -> list[str]:
    cols = scenario_columns(scenario)
    late = known_too_late(scenario, cols)
    if late:
        raise ValueError(f"scenario {scenario!r} would see columns too early: {late}")
    return cols


def scenario_view(df: DataFrame, scenario: str) -> DataFrame:
    """The columns allowed at a decision time (unknown scenario or leakage -> ValueError)."""
    cols = _columns_in_time(scenario)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required feature columns: {missing}")
    return df.select(*cols)


def model_frame(df: DataFrame, scenario: str) -> DataFrame:
    """Features + target as one DataFrame (never split X from y)."""
    cols = _columns_in_time(scenario) + [TARGET]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns for scenario '{scenario}': {missing}")
    return df.select(*cols)


def safe_features(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """Drop identifiers, the target and target-derived names."""
    cols = usable_columns(df.columns)
    if numeric_only:
        num = set(numeric_columns(df))
        cols = [c for c in cols if c in num]
    return df.select(*cols)


def with_quality_ordinal(df: DataFrame, out: str = "Quality_Class_numeric") -> DataFrame:
    return df.withColumn(out, quality_ordinal(TARGET))


def with_risk_flag(df: DataFrame, label: str = TARGET, out: str = "is_risk_class") -> DataFrame:
    return df.withColumn(out, risk_flag(label))


def complete_cases(df: DataFrame, required: list[str]) -> DataFrame:
    return df.select(*required).na.drop("any")


def labelled_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(TARGET).isNotNull())


def with_energy_density(df: DataFrame, out: str = "calculated_energy_density") -> DataFrame:
    return df.withColumn(out, energy_density())


OPERATIONAL_REQUIRED = ["scenario", "model_type", "risk_f2", "risk_recall", "macro_f1", "balanced_accuracy"]


def operational_subset(comparison: DataFrame) -> DataFrame:
    missing = sorted(set(OPERATIONAL_REQUIRED) - set(comparison.columns))
    if missing:
        raise ValueError(f"Comparison CSV is missing required columns: {missing}")
    return comparison.filter(F.col("scenario").isin("prebuild", "inbuild"))


METRIC_NAMES = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1",
                "risk_precision", "risk_recall", "risk_f1", "risk_f2"]


def selection_display(comparison: DataFrame) -> DataFrame:
    """Generic primary/secondary metric columns; each row picks the metric its scenario's policy names."""
    metric_map = F.create_map(*[x for m in METRIC_NAMES for x in (F.lit(m), F.col(m))])
    prim = F.create_map(*[x for s in ("prebuild", "inbuild", "postbuild")
                          for x in (F.lit(s), F.lit(policy_of(s)["primary_metric"]))])
    sec = F.create_map(*[x for s in ("prebuild", "inbuild", "postbuild")
                         for x in (F.lit(s), F.lit(policy_of(s)["secondary_metric"]))])
    return comparison.select(
        "scenario", "model_type",
        prim[F.col("scenario")].alias("primary_metric"),
        metric_map[prim[F.col("scenario")]].alias("primary_value"),
        sec[F.col("scenario")].alias("secondary_metric"),
        metric_map[sec[F.col("scenario")]].alias("secondary_value"),
        "balanced_accuracy", "macro_f1",
    )
