"""Binned and categorical risk tables (the data behind the process-window plots).

Bounds (min/max per axis) come from one global aggregate, inlined into the
rows as a scalar subquery (one value, no join). Bin ids are
computed from the same edge list the interval libraries build (see
``edge_bin``), then one ``groupBy`` with partial aggregation. Skewed bins are
harmless: the map side combines each bin to one row per task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.contract import CATEGORICAL, TARGET
from fusionlens.functions.exprs import edge_bin, risk_flag, unit_hash
from fusionlens.functions.frames import attach_one_row

def attach_bounds(work: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<c>__lo`` / ``<c>__hi`` (global min/max) to every row."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    return attach_one_row(work, work.agg(*aggs))


def _interval(c: str, n: int, k: str, adjust_first: bool):
    lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
    width = (hi - lo) / F.lit(n)
    lower = lo + (F.col(k) - F.lit(1)) * width
    if adjust_first:
        lower = F.when(F.col(k) == 1, lo - (hi - lo) * F.lit(0.001)).otherwise(lower)
    upper = F.when(F.col(k) == n, hi).otherwise(lo + F.col(k) * width)
    return lower, upper


def binned_risk(df: DataFrame, axes: list[tuple[str, int, str]], label: str = TARGET) -> DataFrame:
    """Equal-width right-closed bins on each axis; samples and Poor+Moderate percent per cell.

    ``axes`` = [(column, n_bins, bin_name)]. Rows with a NULL in any required
    column are dropped first (complete cases).
    """
    cols = [a[0] for a in axes]
    work = df.select(*cols, label).na.drop("any")
    work = attach_bounds(work, cols)
    keys = []
    for c, n, name in axes:
        work = work.withColumn(name, edge_bin(c, f"{c}__lo", f"{c}__hi", n, right_closed=True))
        lower, upper = _interval(c, n, name, adjust_first=True)
        work = work.withColumn(f"{name}_lower", lower).withColumn(f"{name}_upper", upper)
        keys += [name, f"{name}_lower", f"{name}_upper"]
    return (
        work.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(risk_flag(label)).alias("_risk"))
        .withColumn("risk_rate_percent", F.lit(100.0) * F.col("_risk") / F.col("samples"))
        .drop("_risk")
    )


def process_window_risk(df: DataFrame, bins: int = 6) -> DataFrame:
    """6x6 power x speed cells: samples and risk percent (flagship query)."""
    return binned_risk(
        df, [("Laser_Power_W", bins, "power_bin"), ("Scan_Speed_mm_s", bins, "speed_bin")]
    )


def process_window_pivot(df: DataFrame, bins: int = 6) -> DataFrame:
    """The same cells as a wide matrix: one row per power bin (high power first),
    ``rate_<k>`` and ``n_<k>`` per speed bin. Keyed by bin id, never by label."""
    cells = process_window_risk(df, bins)
    wide = (
        cells.groupBy("power_bin")
        .pivot("speed_bin", list(range(1, bins + 1)))
        .agg(F.first("risk_rate_percent").alias("rate"), F.first("samples").alias("n"))
    )
    renamed = [F.col("power_bin")]
    for k in range(1, bins + 1):
        renamed += [F.col(f"{k}_rate").alias(f"rate_{k}"), F.col(f"{k}_n").alias(f"n_{k}")]
    return wide.select(*renamed).orderBy(F.desc("power_bin"))


def energy_bin_risk(df: DataFrame, bins: int = 8) -> DataFrame:
    """8 energy-density bins with samples, risk percent and the overall rate."""
    cells = binned_risk(df, [("Energy_Density_J_mm3", bins, "energy_bin")])
    overall = (
        df.select("Energy_Density_J_mm3", TARGET).na.drop("any")
        .agg((F.lit(100.0) * F.sum(risk_flag()) / F.count(F.lit(1))).alias("overall_risk_rate_percent"))
    )
    return attach_one_row(cells, overall)


def category_risk(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Samples and Poor+Moderate percent per category value of each categorical column.

    One ``unpivot`` to (variable, category) and one ``groupBy``; NULL categories
    are dropped like a pandas ``groupby``. Sorted by the 1-decimal percent desc.
    """
    columns = [c for c in (columns or CATEGORICAL) if c in df.columns]
    long = (
        df.select(*[F.col(c).cast("string").alias(c) for c in columns], TARGET)
        .unpivot([TARGET], columns, "variable", "category")
        .filter(F.col("category").isNotNull())
    )
    out = (
        long.groupBy("variable", "category")
        .agg(F.count(F.lit(1)).alias("samples"), F.sum(risk_flag()).alias("risk_count"))
        .withColumn("risk_rate_percent", F.lit(100.0) * F.col("risk_count") / F.col("samples"))
        .withColumn("risk_rate_label", F.format_string("%.1f%%", F.col("risk_rate_percent")))
    )
    return out.orderBy(F.desc(F.round("risk_rate_percent", 1)), "variable", "category")


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """Left-closed equal-width histogram per column (last bin closed), long form.

    Columns are unpivoted once to (feature, value); bounds per feature come from
    one small grouped aggregate joined back by broadcast (one row per feature).
    """
    long = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], columns, "feature", "value")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    bounds = long.groupBy("feature").agg(F.min("value").alias("value__lo"), F.max("value").alias("value__hi"))
    work = long.join(F.broadcast(bounds), "feature")
    work = work.withColumn("bin", edge_bin("value", "value__lo", "value__hi", bins, right_closed=False))
    lower, upper = _interval("value", bins, "bin", adjust_first=False)
    return (
        work.groupBy("feature", "bin", lower.alias("bin_lower"), upper.alias("bin_upper"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def process_points(df: DataFrame, fraction: float | None = None) -> DataFrame:
    """Speed/power/class points of every row; a deterministic sample only if ``fraction`` is given."""
    points = df.select("Sample_ID", "Scan_Speed_mm_s", "Laser_Power_W", TARGET)
    return points if fraction is None else points.filter(unit_hash("Sample_ID") < F.lit(fraction))
