"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fusionlens.contract import QUALITY_ORDER, RISK_CLASSES


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def risk_flag(label="Quality_Class") -> Column:
    """1 for Poor/Moderate, else 0; a NULL label is 0 (bare isin gives NULL)."""
    return F.coalesce(col(label).isin(*RISK_CLASSES).cast("int"), F.lit(0))


def quality_ordinal(label="Quality_Class") -> Column:
    """Poor..Excellent -> 0..3, anything else -> NULL."""
    expr = None
    for i, name in enumerate(QUALITY_ORDER):
        expr = (F.when(col(label) == name, F.lit(i)) if expr is None
                else expr.when(col(label) == name, F.lit(i)))
    return expr


def energy_density(power="Laser_Power_W", speed="Scan_Speed_mm_s", hatch="Hatch_Spacing_mm",
                   layer_um="Layer_Thickness_um") -> Column:
    """P / (v * h * t/1000); a zero denominator gives NULL instead of an error."""
    return F.try_divide(col(power), col(speed) * col(hatch) * (col(layer_um) / F.lit(1000.0)))


def nan_to_null(c) -> Column:
    """NaN and NULL are one concept in the source data: normalise once."""
    return F.when(~F.isnan(col(c).cast("double")), col(c))


def edge_bin(x, lo, hi, n: int, right_closed: bool) -> Column:
    """Equal-width bin id in 1..n from the edge list e_i = lo + i*((hi-lo)/n).

    Left-closed (histogram): 1 + #{e_i <= x}; right-closed (interval cut,
    lowest value included): 1 + #{e_i < x}. Comparing against the same edge
    values the interval libraries build avoids the float drift of
    ``ceil((x-lo)/width)``. A constant column (hi == lo) is one bin.
    """
    x, lo, hi = col(x), col(lo), col(hi)
    width = (hi - lo) / F.lit(n)
    total = F.lit(1)
    for i in range(1, n):
        edge = lo + F.lit(i) * width
        hit = (edge < x) if right_closed else (edge <= x)
        total = total + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    return F.when(hi == lo, F.lit(1)).otherwise(total)


def edge_bin_sql(x: str, lo: str, hi: str, n: int, right_closed: bool) -> str:
    """SQL text of ``edge_bin`` (same arithmetic, for the oracle)."""
    op = "<" if right_closed else "<="
    terms = " + ".join(
        f"CASE WHEN {lo} + {i} * (({hi} - {lo}) / {n}) {op} {x} THEN 1 ELSE 0 END" for i in range(1, n)
    )
    return f"CASE WHEN {hi} = {lo} THEN 1 ELSE 1 + {terms} END"


def guarded_corr(x, y) -> Column:
    """Pearson on pairwise-complete rows; NULL (not an error) for a constant side."""
    x, y = nan_to_null(x), nan_to_null(y)
    both = x.isNotNull() & y.isNotNull()
    xm = F.when(both, x)
    ym = F.when(both, y)
    return F.try_divide(F.covar_pop(xm, ym), F.sqrt(F.var_pop(xm) * F.var_pop(ym)))


def guarded_corr_sql(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xm = f"CASE WHEN {both} THEN {x} END"
    ym = f"CASE WHEN {both} THEN {y} END"
    return f"covar_pop({xm}, {ym}) / NULLIF(sqrt(var_pop({xm}) * var_pop({ym})), 0)"


def adjusted_skewness(x) -> Column:
    """Sample-size adjusted skewness G1; 0 for a constant column, NULL for n < 3."""
    x = nan_to_null(x)
    n = F.count(x)
    g1 = F.skewness(x)
    adj = g1 * F.sqrt(n * (n - F.lit(1))) / (n - F.lit(2))
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.max(x) == F.min(x), F.lit(0.0))
            .otherwise(adj))


def unit_hash(id_col) -> Column:
    """Deterministic pseudo-uniform number in [0, 1) from an integer id.

    Two Lehmer steps modulo 2^31-1: plain integer arithmetic, so any SQL engine
    gives the same value (no engine-specific hash function), and no overflow
    for ids below 1.9e14.
    """
    m = F.lit(2147483647)
    a = F.lit(48271)
    r1 = F.pmod(F.pmod(col(id_col).cast("long"), m) * a, m)
    r2 = F.pmod(r1 * a, m)
    return r2.cast("double") / F.lit(2147483647.0)


def unit_hash_sql(id_col: str) -> str:
    r1 = f"((({id_col}) % 2147483647) * 48271) % 2147483647"
    return f"CAST(((({r1}) * 48271) % 2147483647) AS DOUBLE) / 2147483647.0"


def round_half_even(x, digits: int) -> Column:
    """Round the binary value x * 10^digits half-to-even, then scale back.

    Matches NumPy's rounding of report values (``F.round`` rounds the decimal
    text half-up: 0.00015 -> 0.0002 where NumPy and DuckDB give 0.0001).
    """
    scale = float(10 ** digits)
    return F.rint(col(x) * F.lit(scale)) / F.lit(scale)
