"""Small DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_S = "__one_row"


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame (an aggregate result) to every row.

    The frame becomes one scalar subquery returning a struct: it runs once,
    its single value is inlined into the projection, and no join (let alone a
    nested-loop one) appears in the plan.
    """
    cols = one_row.columns
    value = one_row.select(F.struct(*[F.col(c) for c in cols]).alias(_S)).scalar()
    return df.withColumn(_S, value).select("*", *[F.col(f"{_S}.{c}").alias(c) for c in cols]).drop(_S)
