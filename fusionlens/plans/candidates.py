"""SQL-reproducible candidate predictions for checking evaluation and selection.

Fitted MLlib models cannot be recomputed by an SQL engine, so the value checks
of the evaluation / selection aggregations use candidates whose predictions
are plain expressions: the majority-class ``dummy`` (one of the reference's
own candidates) and one fixed threshold rule per scenario (``rule_baseline``,
a test fixture, not a shipped model). Both see only the columns their
scenario allows. Split: a row is held out when ``unit_hash(Sample_ID) < 0.2``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.contract import TARGET
from fusionlens.functions.exprs import unit_hash
from fusionlens.functions.frames import attach_one_row
from fusionlens.operators.evaluation import majority_class

TEST_SIZE = 0.2
# The check tables have no drift: these low limits make alerts to compare.
CHECK_RISK_DELTA, CHECK_PSI = 1.0, 0.01

RULES = {
    "prebuild": ("CASE WHEN Laser_Power_W >= 300 THEN 'Poor' WHEN Scan_Speed_mm_s >= 1200 THEN 'Moderate' "
                 "ELSE 'Good' END"),
    "inbuild": ("CASE WHEN Energy_Density_J_mm3 >= 90 THEN 'Poor' WHEN Melt_Pool_Depth_um >= 70 THEN 'Moderate' "
                "ELSE 'Good' END"),
    "postbuild": ("CASE WHEN Defect_Count >= 8 THEN 'Poor' WHEN Defect_Count >= 5 THEN 'Moderate' "
                  "WHEN Defect_Count >= 2 THEN 'Good' ELSE 'Excellent' END"),
}
RULE_COLUMNS = ["Laser_Power_W", "Scan_Speed_mm_s", "Energy_Density_J_mm3", "Melt_Pool_Depth_um", "Defect_Count"]
CANDIDATES = [(s, m) for s in ("prebuild", "inbuild", "postbuild") for m in ("dummy", "rule_baseline")]


def split_flag(df: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    return df.withColumn("is_test", unit_hash("Sample_ID") < F.lit(test_size))


def candidate_predictions(df: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """(scenario, model_type, label, prediction) for every held-out row and candidate: one scan, unpivoted."""
    s = split_flag(df.filter(F.col(TARGET).isNotNull()), test_size)
    majority = majority_class(s.filter(~F.col("is_test")))
    test = attach_one_row(s.filter(F.col("is_test")), majority)
    cols = []
    for scen, model in CANDIDATES:
        expr = F.col("majority_class") if model == "dummy" else F.expr(RULES[scen])
        cols.append(expr.alias(f"{scen}__{model}"))
    wide = test.select(F.col(TARGET).alias("label"), *cols)
    names = [f"{s}__{m}" for s, m in CANDIDATES]
    long = wide.unpivot(["label"], names, "candidate", "prediction")
    return long.select(F.split("candidate", "__")[0].alias("scenario"), F.split("candidate", "__")[1].alias("model_type"),
                       "label", "prediction")
