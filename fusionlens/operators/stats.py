"""Level-2 statistical reports.

Two report shapes: one wide aggregate (a single scan, moments and counts per
column, then ``unpivot`` of the one-row result) for skewness and correlation;
the long form (``unpivot`` to (feature, value) then ``groupBy(feature)``) for
quantiles, distinct counts and binned mutual information.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.contract import (
    CATEGORICAL, POST_BUILD, PROCESS, PRODUCTION_RISKS, TARGET, TEXT, THRESHOLDS, numeric_columns,
    non_numeric_columns,
)
from fusionlens.functions.exprs import adjusted_skewness, nan_to_null, round_half_even
from fusionlens.functions.frames import attach_one_row
from fusionlens.operators.neighbours import neighbour_mi
from fusionlens.operators.order_stats import binned_class_counts, class_value_counts, distinct_numbers, exact_quantiles
from fusionlens.operators.quality import as_status_rows

def long_numeric(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., feature, value double) with NaN turned into NULL."""
    sel = [F.col(c) for c in keep] + [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(*sel).unpivot(list(keep), columns, "feature", "value")
    return long.withColumn("value", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")))


def _with_total(df_small: DataFrame, df: DataFrame, name: str = "__n") -> DataFrame:
    return attach_one_row(df_small, df.agg(F.count(F.lit(1)).alias(name)))


def iqr_outliers(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """Per numeric column: q1, q3, iqr, 1.5-iqr bounds, outlier count and percent of all rows.

    The quartiles are found by digit counts (small jobs at plan time); the
    outliers are then one wide aggregate against the bounds.
    """
    cols, k = numeric_columns(df, exclude), THRESHOLDS["iqr_factor"]
    spark = df.sparkSession
    rows = []
    for r in exact_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}):
        iqr = r["q3"] - r["q1"]
        if iqr != 0:
            rows.append((r["feature"], r["q1"], r["q3"], iqr, r["q1"] - k * iqr, r["q3"] + k * iqr))
    bounds = spark.createDataFrame(rows, "feature string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double")
    outside = {f: nan_to_null(F.col(f).cast("double")) for f, *_ in rows}
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[
        F.count_if((outside[f] < lo) | (outside[f] > hi)).alias(f) for f, _, _, _, lo, hi in rows])
    counted = wide.unpivot(["__n"], [r[0] for r in rows], "feature", "outlier_count") if rows else wide.select(
        "__n", F.lit("").alias("feature"), F.lit(0).cast("long").alias("outlier_count"))
    out = bounds.join(counted, "feature")
    cnt = F.col("outlier_count")
    return out.select(
        "feature", "q1", "q3", "iqr", "lower_bound", "upper_bound",
        cnt.alias("outlier_count"),
        round_half_even(cnt / F.col("__n") * F.lit(100.0), 2).alias("outlier_percent"),
        F.when(cnt > 0, "WARN").otherwise("PASS").alias("status"),
        F.when(cnt > 0, TEXT["outlier_yes"]).otherwise(TEXT["outlier_no"]).alias("interpretation"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Count and percent per class (NULL kept), majority/minority ratio on each row."""
    counts = df.groupBy(F.col(TARGET).alias("quality_class")).agg(F.count(F.lit(1)).alias("count"))
    summary = counts.agg(F.min("count").alias("__min"), F.max("count").alias("__max"),
                         F.sum("count").alias("__n"))
    j = attach_one_row(counts, summary)
    ratio = F.try_divide(F.col("__max").cast("double"), F.col("__min").cast("double"))
    return j.select(
        "quality_class", "count",
        round_half_even(F.col("count") / F.col("__n") * F.lit(100.0), 2).alias("percent"),
        round_half_even(ratio, 2).alias("imbalance_ratio_majority_to_minority"),
        F.when(ratio > THRESHOLDS["class_imbalance"], "WARN").otherwise("PASS").alias("status"),
    )


_MOMENTS_SCHEMA = ("i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete co-moments for every column pair (i <= j), summed over all rows.

    Each task turns its Arrow batches into a matrix and computes the k x k
    sums with matrix products (counts, sums, squares, cross products over rows
    where both sides are present); the per-task results, k(k+1)/2 rows each,
    are then summed by a ``groupBy`` with partial aggregation. Values are
    shifted by the global column means first (one small aggregate), so the
    sums do not lose precision to large offsets.
    """
    import numpy as np

    k = len(columns)
    dbl = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    means = df.agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    center = np.array([(means[f"c{i}"] if means[f"c{i}"] is not None else 0.0) for i in range(k)], dtype=float)
    iu, ju = np.triu_indices(k)

    def per_task(batches):
        import pandas as pd
        acc = None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = pdf.to_numpy(dtype=float) - center
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype(float)
            part = (mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0)
            acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
        if acc is None:
            return
        n, s, ss, sab = acc
        yield pd.DataFrame({
            "i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju],
            "sa": s[iu, ju], "sb": s[ju, iu], "saa": ss[iu, ju], "sbb": ss[ju, iu], "sab": sab[iu, ju],
        })

    sums = df.select(*dbl).mapInPandas(per_task, _MOMENTS_SCHEMA).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "idx int, name string")
    return (sums.join(F.broadcast(names.withColumnRenamed("idx", "i").withColumnRenamed("name", "feature_a")), "i")
            .join(F.broadcast(names.withColumnRenamed("idx", "j").withColumnRenamed("name", "feature_b")), "j"))


def correlation_long(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairwise-complete Pearson per pair: (feature_a, feature_b, correlation, pair_order).

    NULL (not an error) when a side has no spread on the shared rows.
    """
    pairs = pairs if pairs is not None else list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "feature_a string, feature_b string, correlation double, pair_order int")
    used = list(dict.fromkeys([c for p in pairs for c in p]))
    mom = pair_moments(df, used)
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va = n * F.col("saa") - sa * sa
    vb = n * F.col("sbb") - sb * sb
    cov = n * F.col("sab") - sa * sb
    # a side with no spread on the shared rows has a (numerically) zero variance
    tiny = F.lit(1e-12)
    ok = (va > tiny * n * F.col("saa") + F.lit(0.0)) & (vb > tiny * n * F.col("sbb") + F.lit(0.0))
    corr = F.when(ok, cov / F.sqrt(va * vb))
    corr = F.when(corr > 1.0, F.lit(1.0)).when(corr < -1.0, F.lit(-1.0)).otherwise(corr)
    mom = mom.select("feature_a", "feature_b", corr.alias("correlation"))
    order = df.sparkSession.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)],
                                            "feature_a string, feature_b string, pair_order int")
    flipped = mom.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    both = mom.unionByName(flipped).dropDuplicates(["feature_a", "feature_b"])
    return both.join(F.broadcast(order), ["feature_a", "feature_b"]).select(
        "feature_a", "feature_b", "correlation", "pair_order")


def correlation_pairs(df: DataFrame, threshold: float = THRESHOLDS["correlation"], exclude: tuple = ()) -> DataFrame:
    """Pairs with |r| >= threshold (WARN), or one PASS row when there are none."""
    cols = numeric_columns(df, exclude)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame(
            [], "feature_a string, feature_b string, correlation double, absolute_correlation double, "
                "status string, interpretation string")
    long = correlation_long(df, cols)
    high = long.filter(F.abs("correlation") >= threshold).select(
        "feature_a", "feature_b",
        round_half_even("correlation", 4).alias("correlation"),
        round_half_even(F.abs("correlation"), 4).alias("absolute_correlation"),
        F.lit("WARN").alias("status"), F.lit(TEXT["corr_high"]).alias("interpretation"))
    none = high.agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") == 0).select(
        F.lit(None).cast("string").alias("feature_a"), F.lit(None).cast("string").alias("feature_b"),
        F.lit(None).cast("double").alias("correlation"), F.lit(None).cast("double").alias("absolute_correlation"),
        F.lit("PASS").alias("status"), F.lit(TEXT["corr_none"]).alias("interpretation"))
    return high.unionByName(none)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Full Pearson matrix in long form (both orders and the diagonal)."""
    cols = columns or numeric_columns(df)
    cols = [c for c in cols if c in df.columns]
    pairs = list(combinations(cols, 2))
    long = correlation_long(df, cols, pairs).select("feature_a", "feature_b", "correlation")
    mirrored = long.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    # diagonal: 1.0 unless the column is constant or empty (then NULL, like a NaN in pandas)
    diag_wide = df.agg(*[F.when(F.min(nan_to_null(c)) < F.max(nan_to_null(c)), F.lit(1.0)).alias(c) for c in cols])
    diag = diag_wide.unpivot([], cols, "feature_a", "correlation").select(
        "feature_a", F.col("feature_a").alias("feature_b"), "correlation")
    return long.unionByName(mirrored).unionByName(diag)


SKETCH_LG = 14  # 2^14 registers: a standard error of about 0.7 %
SKETCH_MARGIN = 0.05


def constant_features(df: DataFrame) -> DataFrame:
    """Distinct values per column (NULL counts as a value) and ratio to rows.

    Numbers are counted by their 64 bits (``distinct_numbers``), other columns in the
    long form: (feature, value as text) -> distinct -> count per feature; a
    wide ``count_distinct`` over many columns would expand every row once per
    column.
    """
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")]
    cols = [c for c in df.columns if c not in numbers]
    parts = [distinct_numbers(df, numbers)] if numbers else []
    if cols:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
        parts.append(long.groupBy("feature", "value").agg(F.lit(1).alias("__u")).groupBy("feature").agg(
            F.count(F.lit(1)).alias("unique_count")))
    uniq = reduce(DataFrame.unionByName, parts)
    out = _with_total(uniq, df)
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("__n").cast("double"))
    status = F.when(F.col("unique_count") <= 1, "WARN").when(ratio < THRESHOLDS["near_constant_ratio"], "WARN") \
        .otherwise("PASS")
    interp = F.when(F.col("unique_count") <= 1, TEXT["constant"]) \
        .when(ratio < THRESHOLDS["near_constant_ratio"], TEXT["near_constant"]).otherwise(TEXT["varied"])
    return out.select("feature", F.col("unique_count").cast("long").alias("unique_count"),
                      round_half_even(ratio, 4).alias("unique_ratio"), status.alias("status"), interp.alias("interpretation"))


def constant_verdicts(df: DataFrame) -> DataFrame:
    """(feature, status, interpretation) of ``constant_features`` without its exact counts.

    One scan: a HyperLogLog sketch of 64-bit hashes per column, merged across tasks, and
    an exact test for one value. Only columns whose estimate lies within
    ``SKETCH_MARGIN`` of the near-constant limit (some seven standard errors) are
    counted exactly by ``constant_features``, which is not run when there are none.
    The scan runs while the plan is built and brings one row to the driver.
    An empty table has no rows here either. NaN is a value, as NULL is.
    """
    cols, limit = df.columns, THRESHOLDS["near_constant_ratio"]
    facts = df.agg(F.count(F.lit(1)).alias("__n"), *[x for i, c in enumerate(cols) for x in (
        F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(c), F.lit(SKETCH_LG))).alias(f"u{i}"),
        (F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(0, F.count(F.lit(1)))).alias(f"one{i}"))]).first()
    n = facts["__n"]
    rows, unsure = [], []
    for i, c in enumerate(cols if n else []):
        if facts[f"one{i}"]:
            rows.append((c, "WARN", TEXT["constant"]))
        elif abs(facts[f"u{i}"] - limit * n) <= SKETCH_MARGIN * limit * n:
            unsure.append(c)
        else:
            near = facts[f"u{i}"] < limit * n
            rows.append((c, "WARN" if near else "PASS", TEXT["near_constant"] if near else TEXT["varied"]))
    sure = df.sparkSession.createDataFrame(rows, "feature string, status string, interpretation string")
    if not unsure:
        return sure
    return sure.unionByName(constant_features(df.select(*unsure)).select("feature", "status", "interpretation"))


def skewness_report(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    cols = numeric_columns(df, exclude)
    wide = df.agg(*[adjusted_skewness(F.col(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot([], cols, "feature", "skew")
    strong = F.abs("skew") > THRESHOLDS["skewness"]
    return long.select(
        "feature",
        round_half_even("skew", 4).alias("skewness"),
        round_half_even(F.abs("skew"), 4).alias("absolute_skewness"),
        F.when(strong, "WARN").otherwise("PASS").alias("status"),
        F.when(strong, TEXT["skew_yes"]).otherwise(TEXT["skew_no"]).alias("interpretation"),
    )


def leakage_candidates(df: DataFrame) -> DataFrame:
    """Column-role table against the table's columns (schema facts only)."""
    present = set(df.columns)
    rows = [(f, "HIGH", "EXCLUDE_FROM_OPERATIONAL_MODEL", "WARN", TEXT["leak_post"]) for f in POST_BUILD if f in present]
    rows += [(f, "LOW", "ALLOWED", "PASS", TEXT["leak_ok"]) for f in PROCESS + CATEGORICAL if f in present]
    return df.sparkSession.createDataFrame(
        rows, "feature string, risk_level string, production_use string, status string, reason string")


def median_fill(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric NULLs and NaNs -> exact column median, found by digit counts (small jobs at plan time)."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return df
    median = {r["feature"]: r["median"] for r in exact_quantiles(df, cols, {"median": 0.5})}
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), F.lit(median.get(c)).cast(df.schema[c].dataType))
              for c in cols}
    return df.withColumns(filled).select(*df.columns)


def category_codes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, category, code): NULL -> "Missing", codes 0.. in sorted order."""
    cols = columns if columns is not None else non_numeric_columns(df, exclude=(TARGET,))
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias(c) for c in cols]).unpivot(
        [], cols, "feature", "category")
    distinct = long.groupBy("feature", "category").agg(F.lit(1).alias("__u")).drop("__u")
    # one window partition per categorical column over its distinct values only
    return distinct.withColumn("code", F.dense_rank().over(Window.partitionBy("feature").orderBy("category")) - 1)


def category_fill_encode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace each categorical column by its ordinal code (NULL -> "Missing" first)."""
    cols = columns if columns is not None else non_numeric_columns(df, exclude=(TARGET,))
    out = df
    for c in cols:
        m = category_codes(df, [c]).select(F.col("category").alias(f"__cat_{c}"), F.col("code").alias(f"__code_{c}"))
        out = out.withColumn(f"__cat_{c}", F.coalesce(F.col(c).cast("string"), F.lit("Missing")))
        out = out.join(m, f"__cat_{c}", "left").withColumn(c, F.col(f"__code_{c}").cast("double")).drop(
            f"__cat_{c}", f"__code_{c}")
    return out


def _mi_input(df: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]], list[str]]:
    """Labelled rows with missing numbers filled by the median and missing texts by "Missing"; bounds of the numbers; text columns."""
    feats = [c for c in df.columns if c not in (TARGET, "Sample_ID")]
    num = [c for c in numeric_columns(df) if c in feats]
    cat = [c for c in feats if c not in num]
    labelled = df.filter(F.col(TARGET).isNotNull())
    bounds, filled = {}, {}
    if num:
        # one wide aggregate: per column the NULL/NaN count and the non-NaN bounds
        # (three numbers per column reach the driver, bounded by the schema)
        clean = {c: nan_to_null(F.col(c).cast("double")) for c in num}
        facts = labelled.agg(*[x for i, c in enumerate(num) for x in (
            F.count_if(clean[c].isNull()).alias(f"n{i}"), F.min(clean[c]).alias(f"lo{i}"),
            F.max(clean[c]).alias(f"hi{i}"))]).first()
        bounds = {c: (facts[f"lo{i}"], facts[f"hi{i}"]) for i, c in enumerate(num)}
        to_fill = [c for i, c in enumerate(num) if facts[f"n{i}"]]
        medians = {r["feature"]: r["median"] for r in exact_quantiles(labelled, to_fill, {"median": 0.5})} if to_fill else {}
        for c in num:
            # the fill value takes the column's own type (an integer column truncates);
            # a median lies inside [min, max], so filling never moves the bin edges
            fill = F.lit(medians.get(c)).cast("double").cast(df.schema[c].dataType).cast("double")
            filled[c] = F.coalesce(clean[c], fill) if c in to_fill else clean[c]
    filled |= {c: F.coalesce(F.col(c).cast("string"), F.lit("Missing")) for c in cat}
    return labelled.withColumns(filled), bounds, cat


def mutual_information(df: DataFrame, bins: int = 20) -> DataFrame:
    """Plug-in mutual information (nats) of each feature with the class, 6 dp, desc.

    Numeric features: NULL -> median, then ``bins`` equal-width left-closed
    bins; categorical features: NULL -> "Missing", each value its own cell.
    MI = sum p(x,y) ln(p(x,y) / (p(x) p(y))) from joint counts of (feature, cell,
    class), which every task adds up over its own batches: one scan, and a
    shuffle of cells. Marginals are window sums over that small table. The bounds come from
    one wide min/max aggregate. Rows with a NULL class are left out.
    """
    if TARGET not in df.columns:
        return df.sparkSession.createDataFrame(
            [], "feature string, mutual_information_score double, status string, interpretation string")
    filled, bounds, cat = _mi_input(df)
    return mi_from_counts(binned_class_counts(filled, bounds, cat, TARGET, bins))


def mi_from_counts(joint: DataFrame, label: str = TARGET) -> DataFrame:
    # the joint table is small (features x cells x classes): marginals are window sums over it
    j = joint.select(
        "feature", "nxy",
        F.sum("nxy").over(Window.partitionBy("feature", "cell")).alias("nx"),
        F.sum("nxy").over(Window.partitionBy("feature", label)).alias("ny"),
        F.sum("nxy").over(Window.partitionBy("feature")).alias("n"),
    )
    # products in double: nxy * n overflows a long at a trillion rows
    nxy = F.col("nxy").cast("double")
    term = (nxy / F.col("n")) * F.log((nxy * F.col("n")) / (F.col("nx").cast("double") * F.col("ny")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("mi"))
    return _mi_report(mi)


def _mi_report(mi: DataFrame) -> DataFrame:
    return mi.select(
        "feature",
        round_half_even(F.greatest(F.col("mi"), F.lit(0.0)), 6).alias("mutual_information_score"),
        F.lit("INFO").alias("status"),
        F.lit(TEXT["mi"]).alias("interpretation"),
    ).orderBy(F.desc("mutual_information_score"), "feature")


def mutual_information_neighbours(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Nearest-neighbour mutual information (nats) of each feature with the class, 6 dp, desc.

    Missing numbers take the median, missing texts "Missing"; a text column counts as the number
    of its category in sorted order. Rows with a NULL class are left out, and so are
    infinite values and columns without any value. See ``neighbours`` for the estimator.
    """
    if TARGET not in df.columns or not set(df.columns) - {TARGET, "Sample_ID"}:
        return df.sparkSession.createDataFrame(
            [], "feature string, mutual_information_score double, status string, interpretation string")
    filled, bounds, cat = _mi_input(df)
    counts = class_value_counts(filled, list(bounds), TARGET) if bounds else None
    if cat:
        texts = filled.select(TARGET, *cat).unpivot([TARGET], cat, "feature", "text").groupBy("feature", "text", TARGET).agg(
            F.count(F.lit(1)).alias("cj"))
        code = F.dense_rank().over(Window.partitionBy("feature").orderBy("text")) - 1
        codes = texts.select("feature", code.cast("double").alias("value"), F.col(TARGET).cast("string").alias(TARGET), "cj")
        counts = counts.unionByName(codes) if counts is not None else codes
    return _mi_report(neighbour_mi(counts, TARGET, buckets=buckets))


def production_risks(leakage: DataFrame, outliers: DataFrame, balance: DataFrame, correlations: DataFrame) -> DataFrame:
    """Five-row risk table from the other reports' counts."""
    leak = leakage.agg(F.count_if(F.col("status") == "WARN").alias("v"))
    outl = outliers.agg(F.count_if(F.col("outlier_count") > 0).alias("v"))
    bal = balance.agg(F.count_if(F.col("status") == "WARN").alias("v"))
    cor = correlations.agg(F.count_if(F.col("status") == "WARN").alias("v"))
    action = dict(PRODUCTION_RISKS)

    def row(frame, risk, sev, evidence):
        return frame.select(F.lit(risk).alias("risk"), sev.alias("severity"), evidence.alias("evidence"),
                            F.lit(action[risk]).alias("recommended_action"), F.lit(len(risk)).alias("__x")).drop("__x")
    v = F.col("v")
    rows = [
        row(leak, "Data leakage", F.when(v > 0, "HIGH").otherwise("LOW"),
            F.format_string("%d leakage-risk features detected.", v)),
        row(outl, "Outliers / unusual process windows", F.when(v > 0, "MEDIUM").otherwise("LOW"),
            F.format_string("%d numeric features contain IQR outliers.", v)),
        row(bal, "Class imbalance", F.when(v > 0, "MEDIUM").otherwise("LOW"),
            F.when(v > 0, "Class imbalance warning detected.").otherwise("No severe class imbalance detected.")),
        row(cor, "Feature redundancy", F.when(v > 0, "MEDIUM").otherwise("LOW"),
            F.format_string("%d highly correlated feature pairs detected.", v)),
        row(leak, "Machine/process drift", F.lit("MEDIUM"),
            F.lit("Dataset does not confirm future machines or powders match training distribution.")),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def statistical_reports(df: DataFrame) -> dict[str, DataFrame]:
    reports = {
        "outliers": iqr_outliers(df),
        "class_balance": class_balance(df),
        "correlations": correlation_pairs(df),
        "constant_features": constant_features(df),
        "skewness": skewness_report(df),
        "leakage_candidates": leakage_candidates(df),
        "mutual_information": mutual_information(df),
    }
    reports["production_risk_assessment"] = production_risks(
        reports["leakage_candidates"], reports["outliers"], reports["class_balance"], reports["correlations"])
    return reports


def statistical_bundle(df: DataFrame) -> DataFrame:
    """Level-2 reports that carry a status, as one long status table."""
    r = statistical_reports(df)
    parts = [
        as_status_rows("outliers", r["outliers"], None, "feature", "outlier_count"),
        as_status_rows("class_balance", r["class_balance"], None, "quality_class", "count"),
        as_status_rows("correlations", r["correlations"], None,
                       F.concat_ws(" vs ", "feature_a", "feature_b"), "correlation"),
        as_status_rows("constant_features", r["constant_features"], None, "feature", "unique_count"),
        as_status_rows("skewness", r["skewness"], None, "feature", "skewness"),
        as_status_rows("leakage_candidates", r["leakage_candidates"], None, "feature"),
        as_status_rows("mutual_information", r["mutual_information"], None, "feature", "mutual_information_score"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
