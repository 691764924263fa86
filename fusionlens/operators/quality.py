"""Level-1 data-quality reports and the PASS / WARN / FAIL gate.

Counting reports use one wide aggregate over the table (a single scan with
partial aggregation, no shuffle of rows) and are then turned long with
``unpivot`` on the one-row result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fusionlens.contract import EXPECTED_COLUMNS, PHYSICAL_RANGES, QUALITY_ORDER, TARGET, TEXT
from fusionlens.functions.exprs import round_half_even, nan_to_null
from fusionlens.functions.frames import attach_one_row
from fusionlens.operators import ranks

def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def _missing(df: DataFrame, c: str):
    m = F.col(c).isNull()
    if _is_float(df, c):
        m = m | F.isnan(c)
    return m


def schema_report(df: DataFrame) -> DataFrame:
    """Missing contract columns -> FAIL, unexpected columns -> WARN, else one PASS row.

    Pure schema facts (driver side, no job)."""
    spark = df.sparkSession
    actual, expected = set(df.columns), set(EXPECTED_COLUMNS)
    rows = [("missing_expected_column", c, "FAIL", TEXT["missing_col"]) for c in sorted(expected - actual)]
    rows += [("unexpected_column", c, "WARN", TEXT["extra_col"]) for c in sorted(actual - expected)]
    if not rows:
        rows = [("schema", None, "PASS", TEXT["schema_ok"])]
    schema = "check string, column string, status string, details string"
    return spark.createDataFrame(rows, schema)


def _missing_counts(df: DataFrame) -> dict:
    return {c: F.count_if(_missing(df, c)) for c in df.columns}


def _missing_report(wide: DataFrame, columns: list[str]) -> DataFrame:
    """From one row of counts by column, and ``__n``."""
    long = wide.unpivot(["__n"], columns, "column", "missing_count")
    pct = F.try_divide(F.col("missing_count").cast("double"), F.col("__n").cast("double")) * F.lit(100.0)
    return long.select(
        "column",
        "missing_count",
        round_half_even(pct, 2).alias("missing_percent"),
        F.when(F.col("missing_count") > 0, "WARN").otherwise("PASS").alias("status"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Per column missing count and percent (2 dp); WARN when > 0."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[n.alias(c) for c, n in _missing_counts(df).items()])
    return _missing_report(wide, df.columns)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each full row (NULLs equal).

    Only a 64-bit hash of each row is shuffled and counted (map-side combine: a
    hot group of copies is one row a task). Rows whose hash occurs more
    than once are then compared in full: hashes that occur once need no look
    at their rows, and without repeated hashes the second step is empty. The
    repeated hashes are written at plan time: where they are few, their size is known
    and the rows are not shuffled to be compared.
    """
    # -0.0 and 0.0 are one group, so they must have one hash
    plain = [F.col(c) + F.lit(0.0) if _is_float(df, c) else F.col(c) for c in df.columns]
    rows = df.withColumn("__h", F.xxhash64(*plain))
    again = ranks.staged(rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select("__h"))
    groups = rows.join(again, "__h", "left_semi").groupBy("__h", *df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("duplicate_count")).select(
        F.lit("duplicate_rows").alias("check"),
        "duplicate_count",
        F.when(F.col("duplicate_count") > 0, "WARN").otherwise("PASS").alias("status"),
    )


def _domain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, i) for i, v in enumerate(QUALITY_ORDER)], "value string, rank int")


def _label_check(observed: DataFrame) -> DataFrame:
    """From the distinct labels (column ``value``)."""
    domain = _domain(observed.sparkSession).select("value")
    unexpected = observed.join(F.broadcast(domain), "value", "left_anti").select(
        F.lit("unexpected_target_label").alias("check"), "value", F.lit("FAIL").alias("status"))
    unseen = domain.join(observed, "value", "left_anti").select(
        F.lit("missing_target_label").alias("check"), "value", F.lit("WARN").alias("status"))
    return unexpected.unionByName(unseen)


def target_label_check(df: DataFrame) -> DataFrame:
    """Labels outside the domain -> FAIL; domain labels never seen -> WARN."""
    if TARGET not in df.columns:
        return df.sparkSession.createDataFrame([("target_column", None, "FAIL")], "check string, value string, status string")
    return _label_check(df.select(F.col(TARGET).alias("value")).filter(F.col("value").isNotNull()).distinct())


def _distribution(counts: DataFrame, total: DataFrame) -> DataFrame:
    """From (value, count) and a one-row total ``__n``."""
    return (
        attach_one_row(counts, total)
        .select(
            F.lit("target_distribution").alias("check"),
            "value",
            "count",
            round_half_even(F.col("count") / F.col("__n") * F.lit(100.0), 2).alias("percent"),
            F.lit("INFO").alias("status"),
        )
    )


def target_distribution(df: DataFrame) -> DataFrame:
    """Count and percent (2 dp) per label incl. NULL; status INFO."""
    spark = df.sparkSession
    if TARGET not in df.columns:
        return spark.createDataFrame(
            [("target_column", "FAIL", TEXT["target_missing"])], "check string, status string, details string")
    counts = df.groupBy(F.col(TARGET).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return _distribution(counts, df.agg(F.count(F.lit(1)).alias("__n")))


def target_report(df: DataFrame) -> DataFrame:
    """Label check rows followed by distribution rows, one table."""
    if TARGET not in df.columns:
        return target_distribution(df)
    return target_label_check(df).unionByName(target_distribution(df), allowMissingColumns=True)


def _rule_text(c, lo, hi) -> str:
    return f"{lo} <= {c} <= {hi}"


def _invalid_counts(df: DataFrame) -> dict:
    found = {}
    for c, lo, hi in PHYSICAL_RANGES:
        if c not in df.columns:
            continue
        value, bad = nan_to_null(c), F.lit(False)
        if lo is not None:
            bad = bad | (value < lo)
        if hi is not None:
            bad = bad | (value > hi)
        found[c] = F.count_if(bad)
    return found


def _range_report(wide: DataFrame, columns: list[str]) -> DataFrame:
    """From one row of counts by column."""
    spark = wide.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, invalid_count long, status string, rule string")
    long = wide.unpivot([], columns, "column", "invalid_count")
    rule_df = spark.createDataFrame([(c, i, _rule_text(c, lo, hi)) for i, (c, lo, hi) in enumerate(PHYSICAL_RANGES) if c in columns],
                                    "column string, __pos int, rule string")
    return long.join(F.broadcast(rule_df), "column").select(
        "column", "invalid_count",
        F.when(F.col("invalid_count") > 0, "WARN").otherwise("PASS").alias("status"),
        "rule",
    )


def physical_ranges(df: DataFrame) -> DataFrame:
    """Out-of-range counts for the physical rules; NULL and NaN are never invalid."""
    counts = _invalid_counts(df)
    return _range_report(df.agg(*[n.alias(c) for c, n in counts.items()]) if counts else df, list(counts))


# ---------------------------------------------------------------------------
# Long status table + gate
# ---------------------------------------------------------------------------

STATUS_SCHEMA = "report string, check string, item string, value double, status string"


def as_status_rows(report_name: str, report: DataFrame, check=None, item=None, value=None) -> DataFrame:
    """Project any report with a ``status`` column into (report, check, item, value, status)."""
    def pick(c, default_name=None):
        if c is None:
            return F.lit(default_name).cast("string") if default_name else F.lit(None).cast("string")
        return F.col(c).cast("string") if isinstance(c, str) else c
    return report.select(
        F.lit(report_name).alias("report"),
        pick(check, report_name).alias("check"),
        pick(item).alias("item"),
        (F.col(value).cast("double") if isinstance(value, str) else F.lit(None).cast("double")).alias("value"),
        F.col("status").cast("string").alias("status"),
    )


def data_quality_bundle(df: DataFrame) -> DataFrame:
    """All level-1 reports as one long status table.

    Every counting report comes from one scan at plan time: counts by label,
    written as a table of one row a label. Only the duplicates read the rows again.
    """
    missing, invalid = _missing_counts(df), _invalid_counts(df)
    label = F.col(TARGET) if TARGET in df.columns else F.lit(None).cast("string")
    counted = ranks.staged(df.groupBy(label.alias("value")).agg(
        F.count(F.lit(1)).alias("count"), F.struct(*[n.alias(c) for c, n in missing.items()]).alias("missing"),
        *([F.struct(*[n.alias(c) for c, n in invalid.items()]).alias("invalid")] if invalid else [])))

    def summed(struct: str, columns) -> list:
        return [F.coalesce(F.sum(f"{struct}.`{c}`"), F.lit(0)).alias(c) for c in columns]

    total = F.coalesce(F.sum("count"), F.lit(0)).alias("__n")
    parts = [
        as_status_rows("schema", schema_report(df), "check", "column"),
        as_status_rows("missing_values", _missing_report(counted.agg(total, *summed("missing", missing)), df.columns), None,
                       "column", "missing_count"),
        as_status_rows("duplicates", duplicate_rows(df), "check", None, "duplicate_count"),
        as_status_rows("physical_ranges", _range_report(counted.agg(*summed("invalid", invalid)) if invalid else counted, list(invalid)),
                       None, "column", "invalid_count"),
    ]
    if TARGET in df.columns:
        observed = counted.select("value").where("value IS NOT NULL")
        parts.append(as_status_rows("target", _label_check(observed), "check", "value"))
        parts.append(as_status_rows("target", _distribution(counted.select("value", "count"), counted.agg(total)), "check", "value",
                                    "count"))
    else:
        parts.append(as_status_rows("target", target_distribution(df), "check", None))
    return reduce(lambda a, b: a.unionByName(b), parts)


def quality_gate(status_rows: DataFrame) -> DataFrame:
    """One row: status, fail_count, warn_count, message."""
    counts = status_rows.agg(
        F.count_if(F.col("status") == "FAIL").alias("fail_count"),
        F.count_if(F.col("status") == "WARN").alias("warn_count"),
    )
    status = (F.when(F.col("fail_count") > 0, "FAIL").when(F.col("warn_count") > 0, "WARN").otherwise("PASS"))
    message = (F.when(F.col("fail_count") > 0, TEXT["gate_fail"])
               .when(F.col("warn_count") > 0, TEXT["gate_warn"]).otherwise(TEXT["gate_pass"]))
    return counts.select(status.alias("status"), "fail_count", "warn_count", message.alias("message"))
