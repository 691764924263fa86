"""How widely to deal out work, and tables written between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionlens.session import shared_path


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shares(df: DataFrame, text_col: str, share_bytes: int) -> int:
    """Number of shares of about ``share_bytes`` of text, one for each shuffle partition at least.

    The text bytes are summed in one pass over that column; results never
    depend on the number, only the size of a task does.
    """
    total = df.agg(F.sum(F.octet_length(df[text_col]).cast("long"))).first()[0] or 0
    return max(shuffle_width(df.sparkSession), -(-total // share_bytes))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read from there.

    Cuts the lineage: a lost executor costs a read of the table, not the work
    before it. The folder is the cluster's ``spark.checkpoint.dir``.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
