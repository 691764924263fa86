"""Arrow-batched pandas UDFs (kept in a module without postponed annotations,
because Spark reads the type hints to pick the UDF kind)."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(h: pd.Series, dof: pd.Series) -> pd.Series:
    """Chi-square upper tail per row (one row per feature in practice)."""
    from fusionlens.operators.challenge import chi2_survival

    return pd.Series([chi2_survival(a, int(b)) for a, b in zip(h, dof)], dtype="float64")
