"""Summary tables (the data behind the overview and audit plots)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.contract import (
    CATEGORICAL, FEATURE_GROUP_LABELS, POST_BUILD, PROCESS, QUALITY_ORDER, RISK_IMPACT, RISK_IMPACT_DEFAULT,
    SEVERITY_SCORE, TARGET, numeric_columns, non_numeric_columns,
)
from fusionlens.functions.exprs import nan_to_null, round_half_even
from fusionlens.functions.frames import attach_one_row
from fusionlens.operators.order_stats import exact_quantiles, quantile_table

def numeric_summary(df: DataFrame) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max per numeric column (exact quartiles): one wide aggregate and digit counts."""
    cols = numeric_columns(df)
    value = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    facts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[F.struct(*[of(value[c]).alias(n) for n, of in facts.items()]).alias(c) for c in cols])
    basic = wide.unpivot([], cols, "feature", "f").select("feature", "f.*")
    qs = quantile_table(df, cols, {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return basic.join(qs, "feature").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def categorical_summary(df: DataFrame) -> DataFrame:
    """Count and percent (2 dp) of every value, NULL included, of every non-numeric column."""
    cols = non_numeric_columns(df)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return attach_one_row(counts, total).select(
        "column", "value", "count", round_half_even(F.col("count") / F.col("__n") * F.lit(100.0), 2).alias("percent"))


def box_stats_by_class(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (most extreme values inside the fences) and outlier counts
    per feature and class.

    Quartiles by digit counts (small jobs at plan time), then one wide aggregate
    a class against its fences: rows are not unpivoted or shuffled.
    """
    cols = columns or [c for c in numeric_columns(df) if c != "Sample_ID"]
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = exact_quantiles(df, cols, probs, by=TARGET)
    rows = [(r["feature"], r["by"], r["n"], r["q1"], r["median"], r["q3"], r["q3"] - r["q1"]) for r in found]
    fences: dict[str, list] = {c: [] for c in cols}
    for f, label, _, q1, _, q3, iqr in rows:
        fences[f].append((label, q1 - 1.5 * iqr, q3 + 1.5 * iqr))
    measures = []
    for c in cols:
        value = nan_to_null(F.col(c).cast("double"))
        inside = F.lit(False)
        for label, lo, hi in fences[c]:  # a fence for each class found
            inside = inside | ((F.col(TARGET) == label) & value.between(lo, hi))
        measures.append(F.struct(F.min(F.when(inside, value)).alias("whisker_low"), F.max(F.when(inside, value)).alias("whisker_high"),
                                 F.count_if(value.isNotNull() & ~inside).alias("outliers")).alias(c))
    wide = df.filter(F.col(TARGET).isNotNull()).groupBy(F.col(TARGET).cast("string").alias(TARGET)).agg(*measures)
    whiskers = wide.unpivot([TARGET], cols, "feature", "w").select("feature", TARGET, "w.*")
    table = df.sparkSession.createDataFrame(
        rows, f"feature string, {TARGET} string, n long, q1 double, median double, q3 double, iqr double")
    return table.join(whiskers, ["feature", TARGET]).select(
        "feature", TARGET, "n", "q1", "median", "q3", "iqr", "whisker_low", "whisker_high", "outliers")


def category_by_class(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of each category value x class, wide in quality order (0 when absent)."""
    cols = [c for c in (columns or CATEGORICAL) if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols], TARGET).unpivot(
        [TARGET], cols, "variable", "category")
    wide = long.groupBy("variable", "category").pivot(TARGET, QUALITY_ORDER).count()
    return wide.select("variable", "category", *[F.coalesce(F.col(q), F.lit(0)).cast("long").alias(q)
                                                  for q in QUALITY_ORDER])


def class_distribution(df: DataFrame) -> DataFrame:
    """Count and share per class in quality order (domain left join) and the imbalance ratio."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(v, i + 1) for i, v in enumerate(QUALITY_ORDER)], f"{TARGET} string, class_order int")
    counts = df.groupBy(TARGET).agg(F.count(F.lit(1)).alias("count"))
    t = domain.join(counts, TARGET, "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    summ = df.agg(F.count(F.lit(1)).alias("__n"))
    present = counts.join(domain, TARGET).agg(F.min("count").alias("__mn"), F.max("count").alias("__mx"))
    return attach_one_row(attach_one_row(t, summ), present).select(
        TARGET, "class_order", "count",
        F.try_divide(F.col("count").cast("double"), F.col("__n").cast("double")).alias("share"),
        F.try_divide(F.col("__mx").cast("double"), F.col("__mn").cast("double")).alias("imbalance_ratio"),
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    """(item, value) facts: rows from one count, the rest from the schema."""
    num = len(numeric_columns(df))
    cat = len(non_numeric_columns(df))
    facts = [
        ("Columns", str(len(df.columns))), ("Target", TARGET), ("Target classes", ", ".join(QUALITY_ORDER)),
        ("Numeric columns", str(num)), ("Categorical columns", str(cat)),
        ("Material / categorical features", str(len(CATEGORICAL))),
        ("Process / monitoring features", str(len(PROCESS))),
        ("Post-build diagnostic features", str(len(POST_BUILD))),
    ]
    rows = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("pos"), F.lit("Rows").alias("item"), F.format_number(F.col("n"), 0).alias("value"))
    rest = df.sparkSession.createDataFrame([(i + 2, a, b) for i, (a, b) in enumerate(facts)],
                                           "pos int, item string, value string")
    return rows.unionByName(rest)


def quality_audit(schema_rep: DataFrame, missing: DataFrame, duplicates: DataFrame, physical: DataFrame,
                  constant: DataFrame) -> DataFrame:
    """Totals of the level-1 reports with PASS/WARN (schema status taken from its report)."""
    def row(pos, name, frame, status, detail):
        return frame.select(F.lit(pos).alias("pos"), F.lit(name).alias("check"), status.alias("status"),
                            detail.alias("detail"))
    sch = schema_rep.agg(F.count_if(F.col("status") == "FAIL").alias("f"), F.count_if(F.col("status") == "WARN").alias("w"))
    mis = missing.agg(F.coalesce(F.sum("missing_count"), F.lit(0)).alias("v"))
    dup = duplicates.agg(F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("v"))
    phy = physical.agg(F.coalesce(F.sum("invalid_count"), F.lit(0)).alias("v"))
    con = constant.agg(F.count_if(F.col("status") == "WARN").alias("v"))
    v = F.col("v")
    pw = F.when(v == 0, "PASS").otherwise("WARN")
    return reduce(lambda a, b: a.unionByName(b), [
        row(1, "Schema validation", sch, F.when(F.col("f") > 0, "FAIL").when(F.col("w") > 0, "WARN").otherwise("PASS"),
            F.when((F.col("f") + F.col("w")) == 0, "Expected columns available")
            .otherwise(F.format_string("%d missing, %d unexpected columns", "f", "w"))),
        row(2, "Missing values", mis, pw, v.cast("string")),
        row(3, "Duplicate rows", dup, pw, v.cast("string")),
        row(4, "Invalid physical ranges", phy, pw, v.cast("string")),
        row(5, "Constant / near-constant features", con, pw, v.cast("string")),
    ])


def top_outlier_features(outliers: DataFrame, top_n: int = 12) -> DataFrame:
    """Top features by outlier percent, identifier dropped; name breaks ties (a top-k report)."""
    return outliers.filter(F.col("feature") != "Sample_ID").orderBy(
        F.desc("outlier_percent"), "feature").limit(top_n).select("feature", "outlier_count", "outlier_percent")


def feature_group_col(feature_col: str = "feature"):
    c = F.col(feature_col)
    return (F.when(c.isin(*POST_BUILD), FEATURE_GROUP_LABELS["post"])
            .when(c.isin(*PROCESS), FEATURE_GROUP_LABELS["process"])
            .when(c.isin(*CATEGORICAL), FEATURE_GROUP_LABELS["categorical"])
            .otherwise(FEATURE_GROUP_LABELS["other"]))


def feature_groups(df: DataFrame) -> DataFrame:
    """Each column's group label with its non-null count (long form, one scan)."""
    cols = df.columns
    wide = df.agg(*[F.count(c).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "non_null").withColumn("feature_group", feature_group_col())


def top_mi_features(mi: DataFrame, top_n: int = 15) -> DataFrame:
    return mi.orderBy(F.desc("mutual_information_score"), "feature").limit(top_n).select(
        "feature", "mutual_information_score", feature_group_col().alias("feature_group"))


def risk_ranking(risks: DataFrame) -> DataFrame:
    """Severity -> 1/2/3 (0 unknown), impact by lookup with a default, ascending score."""
    sev = F.create_map(*[x for k, v in SEVERITY_SCORE.items() for x in (F.lit(k), F.lit(v))])
    imp = F.create_map(*[x for k, v in RISK_IMPACT.items() for x in (F.lit(k), F.lit(v))])
    return risks.select(
        "risk", "severity", F.coalesce(sev[F.col("severity")], F.lit(0)).alias("severity_score"),
        F.coalesce(imp[F.col("risk")], F.lit(RISK_IMPACT_DEFAULT)).alias("impact"), "evidence", "recommended_action",
    ).orderBy("severity_score", "risk")
