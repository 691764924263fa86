"""The ``builds`` table: a build-quality shaped view over the driver's tables.

Each contract column is plain arithmetic over ``lineitem`` joined with
``orders`` (on the order key) and ``part`` (on the part key). The joins are
left joins on primary keys, so a join whose columns are not requested can be
left out without changing the rows: a query that reads only lineitem columns
never shuffles ``orders`` or ``part``.

At scale, ``lineitem``/``orders`` is a large-large equi-join (sort-merge on the
order key, both sides shuffled once); ``part`` is joined on its key and is only
broadcast when its size is known to be small (AQE decides at run time from the
real shuffle statistics). For a whole report run, ``materialize_builds`` writes
the view once to the shared folder and every report re-reads that table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The stand-in column definitions (shared with the SQL oracle).
BUILD_EXPRESSIONS = {
    "Sample_ID": "l_orderkey * 10 + l_linenumber",
    "Alloy_Type": "CASE l_returnflag WHEN 'A' THEN 'Ti-6Al-4V' WHEN 'N' THEN 'Ti-5553' ELSE 'Near-Beta Ti' END",
    "Powder_Morphology": "CASE l_linestatus WHEN 'F' THEN 'Spherical' ELSE 'Irregular' END",
    "Scan_Strategy": "CASE l_linenumber % 3 WHEN 0 THEN 'Stripe' WHEN 1 THEN 'Island' ELSE 'Chessboard' END",
    "Powder_Size_um": "CAST(15 + p_size AS DOUBLE)",
    "Oxygen_Content_percent": "l_tax",
    "Laser_Power_W": "CAST(150 AS DOUBLE) + l_quantity * 4",
    "Scan_Speed_mm_s": "CAST(600 + l_partkey % 900 AS DOUBLE)",
    "Hatch_Spacing_mm": "CAST(0.08 AS DOUBLE) + l_tax / 2",
    "Layer_Thickness_um": "CAST(20 + 5 * l_linenumber AS DOUBLE)",
    "Preheat_Temp_C": "CAST(80 + l_suppkey % 120 AS DOUBLE)",
    "Shielding_Gas_Flow_L_min": "CAST(20 AS DOUBLE)",
    "Melt_Pool_Width_um": "CAST(80 AS DOUBLE) + p_retailprice / 20",
    "Melt_Pool_Depth_um": "CAST(40 AS DOUBLE) + l_discount * 800",
    "Melt_Pool_Temp_C": "CAST(1500 AS DOUBLE) + l_extendedprice / 200",
    "Cooling_Rate_K_s": "CAST(100000 + 10 * l_orderkey AS DOUBLE)",
    "Energy_Density_J_mm3": (
        "CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE (CAST(150 AS DOUBLE) + l_quantity * 4) / "
        "(CAST(600 + l_partkey % 900 AS DOUBLE) * (CAST(0.08 AS DOUBLE) + l_tax / 2) * "
        "(CAST(20 + 5 * l_linenumber AS DOUBLE) / 1000)) * (CAST(95 + l_suppkey % 11 AS DOUBLE) / 100) END"
    ),
    "Thermal_Gradient": "CAST(1000 AS DOUBLE) + o_totalprice / 100",
    "Relative_Density_percent": "CAST(100 AS DOUBLE) - l_discount * 50",
    "Porosity_percent": "l_discount * 50",
    "Microhardness_HV": "CAST(300 AS DOUBLE) + l_quantity",
    "Surface_Roughness_Ra": "l_extendedprice * l_extendedprice * l_extendedprice / CAST(10000000000000 AS DOUBLE)",
    "Tensile_Strength_MPa": "CAST(900 + l_suppkey AS DOUBLE)",
    "Yield_Strength_MPa": "CAST(800 + l_suppkey AS DOUBLE)",
    "Elongation_percent": "l_quantity / 5",
    "Defect_Count": "CAST(l_orderkey % 11 AS INT)",
    "Quality_Class": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Poor' WHEN '2-HIGH' THEN 'Moderate' "
        "WHEN '5-LOW' THEN 'Excellent' ELSE 'Good' END"
    ),
    "event_time": "l_shipdate",
    "machine_id": "l_suppkey",
}

CONTRACT_AND_EXTRA = list(BUILD_EXPRESSIONS)
CONTRACT_COLUMNS = CONTRACT_AND_EXTRA[:27]

# which source table each non-lineitem column needs
_NEEDS_ORDERS = {"Thermal_Gradient", "Quality_Class"}
_NEEDS_PART = {"Powder_Size_um", "Melt_Pool_Width_um"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def builds(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
           with_extras: bool = False) -> DataFrame:
    """The builds view, restricted to ``columns`` (default: the 27 contract columns)."""
    if columns is None:
        columns = CONTRACT_AND_EXTRA if with_extras else CONTRACT_COLUMNS
    return _derived(_joined(spark, sf_dir, columns), columns)


def _derived(joined: DataFrame, columns: list[str]) -> DataFrame:
    return joined.select(*[F.expr(BUILD_EXPRESSIONS[c]).alias(c) for c in columns])


def _joined(spark: SparkSession, sf_dir: str, columns: list[str], how_orders: str | None = None) -> DataFrame:
    """``lineitem`` with the tables that ``columns`` need; ``how_orders`` is a join hint for ``orders``."""
    unknown = [c for c in columns if c not in BUILD_EXPRESSIONS]
    if unknown:
        raise ValueError(f"Unknown builds columns: {unknown}")
    df = read_table(spark, sf_dir, "lineitem")
    if _NEEDS_ORDERS & set(columns):
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
        df = df.join(orders.hint(how_orders) if how_orders else orders, df.l_orderkey == orders.o_orderkey, "left")
    if _NEEDS_PART & set(columns):
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
        df = df.join(part, df.l_partkey == part.p_partkey, "left")
    return df


def written_builds(spark: SparkSession, sf_dir: str, path: str, columns: list[str] | None = None) -> DataFrame:
    """The view over a table joined and written once, for reports that scan it many times.

    What is written are the source columns that ``columns`` are computed from:
    several contract columns share one source column, and the sources
    take far fewer bytes than the arithmetic on them. ``orders`` is merged at
    every size: with a broadcast of small ones the bytes shuffled would jump from
    nothing once the table no longer fits, instead of growing with the rows.
    """
    columns = CONTRACT_COLUMNS if columns is None else columns
    joined = _joined(spark, sf_dir, columns, "merge")
    needed = sorted({name for c in columns for name in re.findall(r"\b[lop]_[a-z]+\b", BUILD_EXPRESSIONS[c])})
    joined.select(*needed).write.option("compression", "zstd").parquet(path)
    return _derived(spark.read.parquet(path), columns)


def materialize_builds(spark: SparkSession, sf_dir: str, path: str, with_extras: bool = True) -> DataFrame:
    """Write the full view once (parquet, shared folder) and return a reader on it.

    A written table cuts the lineage, survives executor loss, and lets every
    report scan only its own columns.
    """
    builds(spark, sf_dir, with_extras=with_extras).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def builds_sql(columns: list[str] | None = None, with_extras: bool = False) -> str:
    """The same view as SQL text (DuckDB and Spark SQL both accept it)."""
    if columns is None:
        columns = CONTRACT_AND_EXTRA if with_extras else CONTRACT_COLUMNS
    select = ",\n  ".join(f"{BUILD_EXPRESSIONS[c]} AS {c}" for c in columns)
    return (
        f"SELECT\n  {select}\nFROM lineitem\n"
        "LEFT JOIN orders ON l_orderkey = o_orderkey\n"
        "LEFT JOIN part ON l_partkey = p_partkey"
    )
