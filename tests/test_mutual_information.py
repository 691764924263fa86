import math

import pandas as pd
from pyspark.sql import functions as F

from fusionlens.operators import stats

BINS = 20


def _brute_force_mi(pdf: pd.DataFrame, numeric: list[str], categorical: list[str], int_cols: set[str]) -> dict:
    lab = pdf[pdf["Quality_Class"].notna()]
    out = {}
    for c in numeric + categorical:
        if c in numeric:
            x = lab[c].astype("float64")
            if x.isna().any():
                med = x.dropna().median()
                fill = float(int(med)) if c in int_cols else med  # an integer column truncates its median
                x = x.fillna(fill)
            lo, hi = x.min(), x.max()
            width = (hi - lo) / BINS
            edges = [lo + i * width for i in range(1, BINS)]
            cells = ["null" if pd.isna(v) else str(1 if hi == lo else 1 + sum(e <= v for e in edges)) for v in x]
        else:
            cells = ["Missing" if pd.isna(v) else str(v) for v in lab[c]]
        t = pd.DataFrame({"cell": cells, "y": lab["Quality_Class"].values})
        joint = t.groupby(["cell", "y"]).size()
        n = joint.sum()
        px = joint.groupby(level=0).sum()
        py = joint.groupby(level=1).sum()
        mi = sum(nxy / n * math.log(nxy * n / (px[cell] * py[y])) for (cell, y), nxy in joint.items())
        out[c] = max(mi, 0.0)
    return out


def test_mutual_information_matches_brute_force(builds_small):
    cols = ["Sample_ID", "Laser_Power_W", "Energy_Density_J_mm3", "Defect_Count", "Alloy_Type", "Quality_Class"]
    # NULLs in an integer column, a text column and the class, on top of the view's own NULL energy values
    df = builds_small.select(*cols).select(
        "Sample_ID", "Laser_Power_W", "Energy_Density_J_mm3",
        F.when(F.col("Sample_ID") % 7 == 0, F.lit(None)).otherwise(F.col("Defect_Count")).alias("Defect_Count"),
        F.when(F.col("Sample_ID") % 5 == 0, F.lit(None)).otherwise(F.col("Alloy_Type")).alias("Alloy_Type"),
        F.when(F.col("Sample_ID") % 11 == 0, F.lit(None)).otherwise(F.col("Quality_Class")).alias("Quality_Class"),
    )
    got = {r["feature"]: r["mutual_information_score"] for r in stats.mutual_information(df, bins=BINS).collect()}
    pdf = df.toPandas()
    assert pdf["Energy_Density_J_mm3"].isna().any() and pdf["Defect_Count"].isna().any()
    want = _brute_force_mi(pdf, ["Laser_Power_W", "Energy_Density_J_mm3", "Defect_Count"], ["Alloy_Type"],
                           {"Defect_Count"})
    assert set(got) == set(want)
    for k, v in want.items():
        assert abs(got[k] - v) <= 1e-6, (k, got[k], v)
