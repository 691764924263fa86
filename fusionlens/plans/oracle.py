"""DuckDB-runnable SQL twins of the registered queries (the correctness oracle).

Every statement starts from the same ``builds`` definition as the Spark side
(``fusionlens.sources.builds``); only tables the driver registers are read.
"""

from __future__ import annotations

from fusionlens.functions.exprs import edge_bin_sql
from fusionlens.sources.builds import builds_sql


def with_builds(body: str, columns: list[str] | None = None, with_extras: bool = False) -> str:
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM (\n{body}\n) w_body"
    return f"WITH builds AS (\n{builds_sql(columns, with_extras)}\n)\n{body}"


def risk_sql(label: str = "Quality_Class") -> str:
    return f"CASE WHEN {label} IN ('Poor', 'Moderate') THEN 1 ELSE 0 END"


def interval_sql(c: str, n: int, k: str, adjust_first: bool) -> tuple[str, str]:
    lo, hi = f"{c}__lo", f"{c}__hi"
    lower = f"{lo} + ({k} - 1) * (({hi} - {lo}) / {n})"
    if adjust_first:
        lower = f"CASE WHEN {k} = 1 THEN {lo} - ({hi} - {lo}) * 0.001 ELSE {lower} END"
    upper = f"CASE WHEN {k} = {n} THEN {hi} ELSE {lo} + {k} * (({hi} - {lo}) / {n}) END"
    return lower, upper


def binned_risk_sql(axes: list[tuple[str, int, str]], extra_select: str = "") -> str:
    cols = [a[0] for a in axes]
    where = " AND ".join(f"{c} IS NOT NULL" for c in cols + ["Quality_Class"])
    bounds = ", ".join(f"min({c}) AS {c}__lo, max({c}) AS {c}__hi" for c in cols)
    bin_cols = []
    keys = []
    for c, n, name in axes:
        bin_cols.append(f"{edge_bin_sql(c, f'{c}__lo', f'{c}__hi', n, True)} AS {name}")
        lower, upper = interval_sql(c, n, name, True)
        keys += [name, f"{name}_lower", f"{name}_upper"]
        bin_cols += [f"{lower} AS {name}_lower_", f"{upper} AS {name}_upper_"]
    # two steps: bin ids first, then interval edges from the ids
    step1 = (
        f"SELECT *, {', '.join(b for b in bin_cols if not b.endswith('_lower_') and not b.endswith('_upper_'))}\n"
        f"FROM (SELECT {', '.join(cols)}, Quality_Class FROM builds WHERE {where}) w,\n"
        f"(SELECT {bounds} FROM builds WHERE {where}) b"
    )
    edge_sel = []
    for c, n, name in axes:
        lower, upper = interval_sql(c, n, name, True)
        edge_sel += [f"{lower} AS {name}_lower", f"{upper} AS {name}_upper"]
    step2 = f"SELECT *, {', '.join(edge_sel)} FROM ({step1}) s1"
    return (
        f"SELECT {', '.join(keys)}, count(*) AS samples,\n"
        f"  100.0 * sum({risk_sql()}) / count(*) AS risk_rate_percent{extra_select}\n"
        f"FROM ({step2}) s2 GROUP BY {', '.join(keys)}"
    )


SQL: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    SQL[name] = sql


register(
    "process_window_risk",
    with_builds(binned_risk_sql([("Laser_Power_W", 6, "power_bin"), ("Scan_Speed_mm_s", 6, "speed_bin")])),
)


# ---------------------------------------------------------------------------
# level-1 / level-2 report SQL (bodies read a ``builds`` relation)
# ---------------------------------------------------------------------------

from fusionlens.contract import (  # noqa: E402
    CATEGORICAL, EXPECTED_COLUMNS, PHYSICAL_RANGES, POST_BUILD, PROCESS, QUALITY_ORDER, TEXT, THRESHOLDS,
)
from fusionlens.functions.exprs import guarded_corr_sql  # noqa: E402
from fusionlens.operators.ranks import quantiles_sql_parts  # noqa: E402

NUMERIC = ["Sample_ID"] + PROCESS + POST_BUILD
FLOAT_COLS = set(PROCESS + POST_BUILD) - {"Defect_Count"}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def long_sql(cols: list[str], src: str = "builds", keep: list[str] = ()) -> str:
    k = "".join(f"{c}, " for c in keep)
    return union_all([f"SELECT {k}{q(c)} AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols])


def missing_values_sql(cols=EXPECTED_COLUMNS) -> str:
    parts = []
    for c in cols:
        miss = f"{c} IS NULL" + (f" OR isnan({c})" if c in FLOAT_COLS else "")
        parts.append(f"SELECT {q(c)} AS \"column\", CAST(sum(CASE WHEN {miss} THEN 1 ELSE 0 END) AS BIGINT) AS missing_count, "
                     f"count(*) AS n FROM builds")
    return (f"SELECT \"column\", missing_count, round_even(missing_count / n * 100.0, 2) AS missing_percent, "
            f"CASE WHEN missing_count > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM ({union_all(parts)}) m")


def duplicate_rows_sql(cols=EXPECTED_COLUMNS) -> str:
    return (f"SELECT 'duplicate_rows' AS \"check\", CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_count, "
            f"CASE WHEN coalesce(sum(c - 1), 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status "
            f"FROM (SELECT count(*) AS c FROM builds GROUP BY {', '.join(cols)}) g")


DOMAIN_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({q(v)})" for v in QUALITY_ORDER) + ") d(value))"


def target_label_check_sql() -> str:
    obs = "(SELECT DISTINCT Quality_Class AS value FROM builds WHERE Quality_Class IS NOT NULL)"
    return (f"SELECT 'unexpected_target_label' AS \"check\", value, 'FAIL' AS status FROM {obs} o "
            f"WHERE value NOT IN (SELECT value FROM {DOMAIN_SQL} d1)\nUNION ALL\n"
            f"SELECT 'missing_target_label' AS \"check\", value, 'WARN' AS status FROM {DOMAIN_SQL} d "
            f"WHERE value NOT IN (SELECT value FROM {obs} o2)")


def target_distribution_sql() -> str:
    return ("SELECT 'target_distribution' AS \"check\", Quality_Class AS value, count(*) AS count, "
            "round_even(count(*) / (SELECT count(*) FROM builds) * 100.0, 2) AS percent, 'INFO' AS status "
            "FROM builds GROUP BY Quality_Class")


def physical_ranges_sql() -> str:
    parts = []
    for c, lo, hi in PHYSICAL_RANGES:
        conds = []
        if lo is not None:
            conds.append(f"{c} < {lo}")
        if hi is not None:
            conds.append(f"{c} > {hi}")
        bad = " OR ".join(conds)
        parts.append(f"SELECT {q(c)} AS \"column\", CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT) AS invalid_count, "
                     f"{q(f'{lo} <= {c} <= {hi}')} AS rule FROM builds")
    return (f"SELECT \"column\", invalid_count, CASE WHEN invalid_count > 0 THEN 'WARN' ELSE 'PASS' END AS status, rule "
            f"FROM ({union_all(parts)}) p")


def schema_report_sql(actual: list[str]) -> str:
    rows = [("missing_expected_column", c, "FAIL", TEXT["missing_col"]) for c in sorted(set(EXPECTED_COLUMNS) - set(actual))]
    rows += [("unexpected_column", c, "WARN", TEXT["extra_col"]) for c in sorted(set(actual) - set(EXPECTED_COLUMNS))]
    if not rows:
        rows = [("schema", None, "PASS", TEXT["schema_ok"])]
    vals = ", ".join(f"({q(a)}, {('NULL' if b is None else q(b))}, {q(c)}, {q(d)})" for a, b, c, d in rows)
    return f"SELECT * FROM (VALUES {vals}) s(\"check\", \"column\", status, details)"


def status_rows_sql(report: str, body: str, check: str | None, item: str | None, value: str | None) -> str:
    ch = f"CAST({check} AS VARCHAR)" if check else q(report)
    it = f"CAST({item} AS VARCHAR)" if item else "CAST(NULL AS VARCHAR)"
    va = f"CAST({value} AS DOUBLE)" if value else "CAST(NULL AS DOUBLE)"
    return f"SELECT {q(report)} AS report, {ch} AS \"check\", {it} AS item, {va} AS value, status FROM ({body}) r_{report}"


def data_quality_bundle_sql(actual: list[str]) -> str:
    return union_all([
        status_rows_sql("schema", schema_report_sql(actual), '"check"', '"column"', None),
        status_rows_sql("missing_values", missing_values_sql(actual), None, '"column"', "missing_count"),
        status_rows_sql("duplicates", duplicate_rows_sql(actual), '"check"', None, "duplicate_count"),
        status_rows_sql("physical_ranges", physical_ranges_sql(), None, '"column"', "invalid_count"),
        status_rows_sql("target", target_label_check_sql(), '"check"', "value", None),
        status_rows_sql("target", target_distribution_sql(), '"check"', "value", "count"),
    ])


def gate_sql(status_rows: str) -> str:
    return (f"SELECT CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
            f"f AS fail_count, w AS warn_count, "
            f"CASE WHEN f > 0 THEN {q(TEXT['gate_fail'])} WHEN w > 0 THEN {q(TEXT['gate_warn'])} "
            f"ELSE {q(TEXT['gate_pass'])} END AS message FROM "
            f"(SELECT count(*) FILTER (WHERE status = 'FAIL') AS f, count(*) FILTER (WHERE status = 'WARN') AS w "
            f"FROM ({status_rows}) s) g")


def iqr_outliers_sql(cols=NUMERIC) -> str:
    long = f"(SELECT * FROM ({long_sql(cols)}) l0 WHERE value IS NOT NULL AND NOT isnan(value))"
    qs = quantiles_sql_parts("lg", ["feature"], "value", {"q1": 0.25, "q3": 0.75})
    k = THRESHOLDS["iqr_factor"]
    return (
        f"WITH lg AS {long}, qs AS ({qs}), b AS (SELECT feature, q1, q3, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lower_bound, "
        f"q3 + {k} * (q3 - q1) AS upper_bound FROM qs WHERE q3 - q1 <> 0), "
        f"c AS (SELECT b.feature, count(*) FILTER (WHERE lg.value < b.lower_bound OR lg.value > b.upper_bound) AS oc "
        f"FROM lg JOIN b ON lg.feature = b.feature GROUP BY b.feature) "
        f"SELECT b.feature, q1, q3, iqr, lower_bound, upper_bound, CAST(coalesce(oc, 0) AS BIGINT) AS outlier_count, "
        f"round_even(coalesce(oc, 0) / (SELECT count(*) FROM builds) * 100.0, 2) AS outlier_percent, "
        f"CASE WHEN coalesce(oc, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status, "
        f"CASE WHEN coalesce(oc, 0) > 0 THEN {q(TEXT['outlier_yes'])} ELSE {q(TEXT['outlier_no'])} END AS interpretation "
        f"FROM b LEFT JOIN c ON b.feature = c.feature"
    )


def class_balance_sql() -> str:
    return (
        "WITH c AS (SELECT Quality_Class AS quality_class, count(*) AS count FROM builds GROUP BY Quality_Class), "
        "s AS (SELECT min(count) AS mn, max(count) AS mx, sum(count) AS n FROM c) "
        "SELECT quality_class, count, round_even(count / n * 100.0, 2) AS percent, "
        "round_even(CAST(mx AS DOUBLE) / NULLIF(mn, 0), 2) AS imbalance_ratio_majority_to_minority, "
        f"CASE WHEN CAST(mx AS DOUBLE) / NULLIF(mn, 0) > {THRESHOLDS['class_imbalance']} THEN 'WARN' ELSE 'PASS' END AS status "
        "FROM c, s"
    )


def correlation_long_sql(pairs: list[tuple[str, str]], src: str = "builds") -> str:
    return union_all([
        f"SELECT {q(a)} AS feature_a, {q(b)} AS feature_b, "
        f"{guarded_corr_sql(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')} AS correlation FROM {src}"
        for a, b in pairs
    ])


def correlation_pairs_sql(cols=NUMERIC, threshold=THRESHOLDS["correlation"]) -> str:
    from itertools import combinations
    pairs = list(combinations(cols, 2))
    high = (f"SELECT feature_a, feature_b, round_even(correlation, 4) AS correlation, "
            f"round_even(abs(correlation), 4) AS absolute_correlation, 'WARN' AS status, {q(TEXT['corr_high'])} AS interpretation "
            f"FROM ({correlation_long_sql(pairs)}) l WHERE abs(correlation) >= {threshold}")
    return (f"WITH h AS ({high}) SELECT * FROM h UNION ALL "
            f"SELECT CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 'PASS', "
            f"{q(TEXT['corr_none'])} WHERE NOT EXISTS (SELECT 1 FROM h)")


def constant_features_sql(cols=EXPECTED_COLUMNS) -> str:
    parts = [f"SELECT {q(c)} AS feature, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS u, "
             f"count(*) AS n FROM builds" for c in cols]
    thr = THRESHOLDS["near_constant_ratio"]
    return (f"SELECT feature, CAST(u AS BIGINT) AS unique_count, round_even(u / n, 4) AS unique_ratio, "
            f"CASE WHEN u <= 1 THEN 'WARN' WHEN u / n < {thr} THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN u <= 1 THEN {q(TEXT['constant'])} WHEN u / n < {thr} THEN {q(TEXT['near_constant'])} "
            f"ELSE {q(TEXT['varied'])} END AS interpretation FROM ({union_all(parts)}) u")


def skew_sql(c: str, src: str = "builds") -> str:
    x = f"CAST({c} AS DOUBLE)"
    return (f"(SELECT CASE WHEN count({x}) < 3 THEN NULL WHEN max({x}) = min({x}) THEN 0.0 ELSE "
            f"(avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5)) * sqrt(count({x}) * (count({x}) - 1.0)) "
            f"/ (count({x}) - 2.0) END FROM {src}, (SELECT avg({x}) AS m FROM {src}) mm)")


def skewness_sql(cols=NUMERIC) -> str:
    parts = [f"SELECT {q(c)} AS feature, {skew_sql(c)} AS s" for c in cols]
    thr = THRESHOLDS["skewness"]
    return (f"SELECT feature, round_even(s, 4) AS skewness, round_even(abs(s), 4) AS absolute_skewness, "
            f"CASE WHEN abs(s) > {thr} THEN 'WARN' ELSE 'PASS' END AS status, "
            f"CASE WHEN abs(s) > {thr} THEN {q(TEXT['skew_yes'])} ELSE {q(TEXT['skew_no'])} END AS interpretation "
            f"FROM ({union_all(parts)}) s")


def leakage_candidates_sql(actual: list[str]) -> str:
    rows = [(f, "HIGH", "EXCLUDE_FROM_OPERATIONAL_MODEL", "WARN", TEXT["leak_post"]) for f in POST_BUILD if f in actual]
    rows += [(f, "LOW", "ALLOWED", "PASS", TEXT["leak_ok"]) for f in PROCESS + CATEGORICAL if f in actual]
    vals = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {vals}) l(feature, risk_level, production_use, status, reason)"


def median_fill_sql(cols: list[str], src: str = "builds", keep: list[str] = ()) -> str:
    """SELECT with each numeric column's NULLs replaced by its median."""
    meds = []
    for c in cols:
        med = quantiles_sql_parts(f"(SELECT 'x' AS k, CAST({c} AS DOUBLE) AS v FROM {src})", ["k"], "v", {"m": 0.5})
        meds.append(f"coalesce(CAST({c} AS DOUBLE), (SELECT m FROM ({med}) mq)) AS {c}")
    return f"SELECT {''.join(k + ', ' for k in keep)}{', '.join(meds)} FROM {src}"


def mutual_information_sql(num: list[str], cat: list[str], bins: int = 20) -> str:
    filled = median_fill_sql(num, "lb", keep=["Quality_Class"])
    num_long = long_sql(num, "filled", keep=["Quality_Class"])
    cells_num = (f"SELECT l.feature, l.Quality_Class, CAST({edge_bin_sql('l.value', 'b.lo', 'b.hi', bins, False)} AS VARCHAR) AS cell "
                 f"FROM nl l JOIN (SELECT feature, min(value) AS lo, max(value) AS hi FROM nl GROUP BY feature) b "
                 f"ON l.feature = b.feature")
    cells_cat = union_all([f"SELECT {q(c)} AS feature, Quality_Class, coalesce(CAST({c} AS VARCHAR), 'Missing') AS cell FROM lb"
                           for c in cat])
    return (
        f"WITH lb AS (SELECT * FROM builds WHERE Quality_Class IS NOT NULL), filled AS ({filled}), nl AS ({num_long}), "
        f"cells AS ({cells_num} UNION ALL {cells_cat}), "
        f"j AS (SELECT feature, cell, Quality_Class, count(*) AS nxy FROM cells GROUP BY ALL), "
        f"px AS (SELECT feature, cell, sum(nxy) AS nx FROM j GROUP BY ALL), "
        f"py AS (SELECT feature, Quality_Class, sum(nxy) AS ny FROM j GROUP BY ALL), "
        f"nn AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL) "
        f"SELECT j.feature, round_even(greatest(sum((nxy / n) * ln((nxy * n) / (nx * ny))), 0.0), 6) AS mutual_information_score, "
        f"'INFO' AS status, {q(TEXT['mi'])} AS interpretation "
        f"FROM j JOIN px USING (feature, cell) JOIN py USING (feature, Quality_Class) JOIN nn USING (feature) GROUP BY j.feature"
    )


def mutual_information_neighbours_sql(num: list[str], cat: list[str], k: int = 3) -> str:
    from fusionlens.operators.neighbours import digamma_sql

    key = "feature, Quality_Class, value"
    texts = union_all([f"SELECT {q(c)} AS feature, Quality_Class, coalesce(CAST({c} AS VARCHAR), 'Missing') AS category FROM lb"
                       for c in cat])
    near = " UNION ALL ".join(
        f"SELECT {key}, cj, ny, abs({f}(value, {i}) OVER w - value) AS d, {f}(cj, {i}) OVER w AS c, {f}(value, {i}) OVER w AS v "
        f"FROM own WINDOW w AS (PARTITION BY feature, Quality_Class ORDER BY value)"
        for f in ("lag", "lead") for i in range(1, k + 1))
    return (
        f"WITH lb AS (SELECT * FROM builds WHERE Quality_Class IS NOT NULL), "
        f"filled AS ({median_fill_sql(num, 'lb', keep=['Quality_Class'])}), "
        f"nl AS ({long_sql(num, 'filled', keep=['Quality_Class'])}), tx AS ({texts}), "
        f"x AS (SELECT Quality_Class, feature, value FROM nl WHERE value IS NOT NULL UNION ALL SELECT Quality_Class, feature, "
        f"CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS DOUBLE) AS value FROM tx), "
        f"v AS (SELECT {key}, count(*) AS cj FROM x GROUP BY ALL), "
        f"t AS (SELECT feature, Quality_Class, sum(cj) AS ny FROM v GROUP BY ALL HAVING sum(cj) > 1), "
        f"own AS (SELECT v.*, t.ny FROM v JOIN t USING (feature, Quality_Class)), "
        f"nb AS (SELECT * FROM ({near}) a WHERE d IS NOT NULL "
        f"UNION ALL SELECT {key}, cj, ny, 0.0 AS d, cj - 1 AS c, value AS v FROM own), "
        f"cum AS (SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY d) AS have FROM nb), "
        f"rad AS (SELECT {key}, cj, ny, min(d) AS r FROM cum WHERE have >= least({k}, ny - 1) GROUP BY ALL), "
        f"e AS (SELECT feature, rad.Quality_Class, rad.value, rad.cj, rad.ny, max(have) AS k, "
        f"least(rad.value - r, min(cum.v)) AS lo, greatest(rad.value + r, max(cum.v)) AS hi "
        f"FROM rad JOIN cum USING (feature, Quality_Class, value) WHERE cum.d <= r GROUP BY feature, rad.Quality_Class, rad.value, "
        f"rad.cj, rad.ny, r), "
        f"p AS (SELECT feature, value, sum(sum(cj)) OVER (PARTITION BY feature ORDER BY value) AS upto FROM own GROUP BY feature, value), "
        f"m AS (SELECT e.*, h.upto - coalesce(l.upto, 0) - 1 AS m FROM e ASOF JOIN p h ON e.feature = h.feature AND e.hi >= h.value "
        f"ASOF LEFT JOIN p l ON e.feature = l.feature AND e.lo > l.value), "
        f"s AS (SELECT feature, sum(cj) AS n, sum(cj * ({digamma_sql('k')} - {digamma_sql('ny')} - {digamma_sql('m')})) AS s "
        f"FROM m GROUP BY feature) "
        f"SELECT feature, round_even(greatest({digamma_sql('n')} + s / n, 0.0), 6) AS mutual_information_score, "
        f"'INFO' AS status, {q(TEXT['mi'])} AS interpretation FROM s")


def category_codes_sql(cols=CATEGORICAL) -> str:
    d = union_all([f"SELECT DISTINCT {q(c)} AS feature, coalesce(CAST({c} AS VARCHAR), 'Missing') AS category FROM builds"
                   for c in cols])
    return (f"SELECT feature, category, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY category) - 1 AS INTEGER) "
            f"AS code FROM ({d}) d")


def production_risks_sql(actual: list[str]) -> str:
    from fusionlens.contract import PRODUCTION_RISKS
    act = dict(PRODUCTION_RISKS)
    return (
        f"WITH lk AS ({leakage_candidates_sql(actual)}), ol AS ({iqr_outliers_sql()}), cb AS ({class_balance_sql()}), "
        f"cr AS ({correlation_pairs_sql()}), "
        f"v AS (SELECT (SELECT count(*) FROM lk WHERE status = 'WARN') AS lv, "
        f"(SELECT count(*) FROM ol WHERE outlier_count > 0) AS ov, (SELECT count(*) FROM cb WHERE status = 'WARN') AS bv, "
        f"(SELECT count(*) FROM cr WHERE status = 'WARN') AS cv) "
        f"SELECT 'Data leakage' AS risk, CASE WHEN lv > 0 THEN 'HIGH' ELSE 'LOW' END AS severity, "
        f"printf('%d leakage-risk features detected.', lv) AS evidence, {q(act['Data leakage'])} AS recommended_action FROM v "
        f"UNION ALL SELECT 'Outliers / unusual process windows', CASE WHEN ov > 0 THEN 'MEDIUM' ELSE 'LOW' END, "
        f"printf('%d numeric features contain IQR outliers.', ov), {q(act['Outliers / unusual process windows'])} FROM v "
        f"UNION ALL SELECT 'Class imbalance', CASE WHEN bv > 0 THEN 'MEDIUM' ELSE 'LOW' END, "
        f"CASE WHEN bv > 0 THEN 'Class imbalance warning detected.' ELSE 'No severe class imbalance detected.' END, "
        f"{q(act['Class imbalance'])} FROM v "
        f"UNION ALL SELECT 'Feature redundancy', CASE WHEN cv > 0 THEN 'MEDIUM' ELSE 'LOW' END, "
        f"printf('%d highly correlated feature pairs detected.', cv), {q(act['Feature redundancy'])} FROM v "
        f"UNION ALL SELECT 'Machine/process drift', 'MEDIUM', "
        f"'Dataset does not confirm future machines or powders match training distribution.', "
        f"{q(act['Machine/process drift'])} FROM v"
    )


def statistical_bundle_sql(actual: list[str]) -> str:
    num = [c for c in NUMERIC if c in actual]
    mi_num = [c for c in num if c != "Sample_ID"]
    mi_cat = [c for c in CATEGORICAL if c in actual]
    return union_all([
        status_rows_sql("outliers", iqr_outliers_sql(num), None, "feature", "outlier_count"),
        status_rows_sql("class_balance", class_balance_sql(), None, "quality_class", "count"),
        status_rows_sql("correlations", correlation_pairs_sql(num), None,
                        "concat_ws(' vs ', feature_a, feature_b)", "correlation"),
        status_rows_sql("constant_features", constant_features_sql(actual), None, "feature", "unique_count"),
        status_rows_sql("skewness", skewness_sql(num), None, "feature", "skewness"),
        status_rows_sql("leakage_candidates", leakage_candidates_sql(actual), None, "feature", None),
        status_rows_sql("mutual_information", mutual_information_sql(mi_num, mi_cat), None, "feature",
                        "mutual_information_score"),
    ])


_C = EXPECTED_COLUMNS
_MI_NUM = PROCESS + POST_BUILD
register("schema_report", with_builds(schema_report_sql(_C + ["event_time", "machine_id"]), with_extras=True))
register("missing_values", with_builds(missing_values_sql()))
register("duplicate_rows", with_builds(duplicate_rows_sql()))
register("target_label_check", with_builds(target_label_check_sql()))
register("target_distribution", with_builds(target_distribution_sql()))
register("physical_ranges", with_builds(physical_ranges_sql()))
register("data_quality_bundle", with_builds(data_quality_bundle_sql(_C)))
register("quality_gate", with_builds(gate_sql(union_all([data_quality_bundle_sql(_C), statistical_bundle_sql(_C)]))))
register("iqr_outliers", with_builds(iqr_outliers_sql()))
register("class_balance", with_builds(class_balance_sql()))
register("correlation_pairs", with_builds(correlation_pairs_sql()))
register("constant_features", with_builds(constant_features_sql()))
register("constant_verdicts", with_builds(f"SELECT feature, status, interpretation FROM ({constant_features_sql()}) c"))
register("skewness_report", with_builds(skewness_sql()))
register("leakage_candidates", with_builds(leakage_candidates_sql(_C)))
register("mutual_information", with_builds(mutual_information_sql(_MI_NUM, CATEGORICAL)))
register("mutual_information_neighbours", with_builds(mutual_information_neighbours_sql(_MI_NUM, CATEGORICAL)))
register("median_fill", with_builds(median_fill_sql(NUMERIC)))
register("category_fill_encode", with_builds(category_codes_sql()))
register("category_encode_rows", with_builds("SELECT Sample_ID, " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Missing')) - 1 AS DOUBLE) AS {c}" for c in CATEGORICAL) + " FROM builds"))
register("production_risks", with_builds(production_risks_sql(_C)))
register("statistical_bundle", with_builds(statistical_bundle_sql(_C)))


# ---------------------------------------------------------------------------
# challenges, summaries, projections
# ---------------------------------------------------------------------------

from fusionlens.contract import (  # noqa: E402
    FEATURE_GROUP_LABELS, IDENTIFIER_COLUMNS, PHYSICS_PAIRS, RISK_IMPACT,
    RISK_IMPACT_DEFAULT, SEVERITY_SCORE, TARGET, scenario_columns, usable_columns,
)

SAFE_NUMERIC = PROCESS + POST_BUILD  # numeric minus identifiers / target
ORDINAL_SQL = ("CASE Quality_Class WHEN 'Poor' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Good' THEN 2 "
               "WHEN 'Excellent' THEN 3 END")


def histogram_sql(cols: list[str], bins: int, src: str = "builds") -> str:
    lg = f"(SELECT * FROM ({long_sql(cols, src)}) l0 WHERE value IS NOT NULL AND NOT isnan(value))"
    lower, upper = interval_sql("value", bins, "bin", False)
    return (f"SELECT feature, bin, {lower} AS bin_lower, {upper} AS bin_upper, count(*) AS count FROM ("
            f"SELECT l.feature, value__lo, value__hi, {edge_bin_sql('l.value', 'value__lo', 'value__hi', bins, False)} AS bin "
            f"FROM {lg} l JOIN (SELECT feature, min(value) AS value__lo, max(value) AS value__hi FROM {lg} g "
            f"GROUP BY feature) b ON l.feature = b.feature) h GROUP BY feature, bin, value__lo, value__hi")


def distribution_challenge_sql(cols=SAFE_NUMERIC, bins: int = 20) -> str:
    lg = f"(SELECT * FROM ({long_sql(cols)}) l0 WHERE value IS NOT NULL AND NOT isnan(value))"
    return (
        f"WITH h AS ({histogram_sql(cols, bins)}), hn AS (SELECT * FROM h WHERE count > 0), "
        f"t AS (SELECT feature, sum(count) AS n, count(*) AS k FROM hn GROUP BY feature), "
        f"u AS (SELECT hn.feature, t.k, -sum((count / n) * ln(count / n)) AS ent FROM hn JOIN t USING (feature) "
        f"GROUP BY hn.feature, t.k), "
        f"b AS (SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std, "
        f"count(DISTINCT value) AS unique_values FROM {lg} l GROUP BY feature), "
        f"j AS (SELECT b.*, CASE WHEN unique_values <= 1 THEN 0.0 WHEN u.k <= 1 THEN 0.0 "
        f"ELSE coalesce(u.ent / ln(u.k), 0.0) END AS uniformity_score FROM b LEFT JOIN u USING (feature)) "
        f"SELECT feature, min, max, mean, std, unique_values, uniformity_score, "
        f"CASE WHEN uniformity_score >= {THRESHOLDS['uniform']} THEN {q(TEXT['uniform_yes'])} "
        f"ELSE {q(TEXT['uniform_no'])} END AS interpretation FROM j"
    )


def physics_correlations_sql() -> str:
    parts = []
    for left, right, expect in PHYSICS_PAIRS:
        r = ORDINAL_SQL if right == TARGET else right
        parts.append(f"SELECT {q(left + ' vs ' + right)} AS relationship, "
                     f"{guarded_corr_sql(f'CAST({left} AS DOUBLE)', f'CAST({r} AS DOUBLE)')} AS correlation, "
                     f"{q(expect)} AS expected_physics FROM builds")
    thr = THRESHOLDS["weak_correlation"]
    return (f"SELECT relationship, correlation, abs(correlation) AS absolute_correlation, expected_physics, "
            f"CASE WHEN correlation IS NULL THEN {q(TEXT['not_computable'])} WHEN abs(correlation) < {thr} "
            f"THEN {q(TEXT['weak_pair'])} ELSE {q(TEXT['visible_pair'])} END AS interpretation FROM ({union_all(parts)}) p")


def energy_formula_sql() -> str:
    calc = ("Laser_Power_W / NULLIF(Scan_Speed_mm_s * Hatch_Spacing_mm * (Layer_Thickness_um / 1000.0), 0)")
    w = ("SELECT Energy_Density_J_mm3 AS o, " + calc + " AS c FROM builds WHERE Laser_Power_W IS NOT NULL AND "
         "Scan_Speed_mm_s IS NOT NULL AND Hatch_Spacing_mm IS NOT NULL AND Layer_Thickness_um IS NOT NULL AND "
         "Energy_Density_J_mm3 IS NOT NULL")
    thr = THRESHOLDS["energy_formula_corr"]
    return (
        f"SELECT 'energy_density_formula' AS \"check\", CASE WHEN n = 0 THEN 'SKIPPED' WHEN r >= {thr} THEN 'PASS' "
        f"ELSE 'WARN' END AS status, CASE WHEN n = 0 THEN {q(TEXT['energy_no_rows'])} END AS reason, "
        f"n AS rows_checked, r AS correlation_observed_vs_calculated, mae AS mean_absolute_error, "
        f"mape AS mean_absolute_percent_error, CASE WHEN n = 0 THEN NULL WHEN r >= {thr} THEN {q(TEXT['energy_pass'])} "
        f"ELSE {q(TEXT['energy_warn'])} END AS interpretation FROM (SELECT count(*) AS n, "
        f"{guarded_corr_sql('o', 'c')} AS r, avg(abs(o - c)) AS mae, avg(abs((o - c) / NULLIF(o, 0))) * 100.0 AS mape "
        f"FROM ({w}) w) a"
    )


def chi2_tail_sql(h: str = "kruskal_statistic", dof: str = "degrees_of_freedom", terms: int = 1000) -> str:
    """Upper chi-square tail: one minus the power series of the lower incomplete gamma function."""
    a, x = f"({dof} / 2.0)", f"({h} / 2.0)"
    series = (f"list_sum(list_transform(range({terms}), lambda j: exp(j * ln({x}) - (lgamma({a} + 1 + j) - lgamma({a} + 1)))))")
    return (f"CASE WHEN {h} <= 0 THEN 1.0 WHEN {h} > 1000 THEN 0.0 ELSE "
            f"greatest(0.0, 1.0 - exp({a} * ln({x}) - {x} - lgamma({a} + 1)) * {series}) END")


def kruskal_sql(cols=SAFE_NUMERIC) -> str:
    lg = (f"(SELECT * FROM ({long_sql(cols, 'lb', keep=['Quality_Class'])}) l0 WHERE value IS NOT NULL "
          f"AND NOT isnan(value))")
    return (
        f"WITH lb AS (SELECT * FROM builds WHERE Quality_Class IS NOT NULL), lg AS {lg}, "
        f"pv AS (SELECT feature, value, count(*) AS cnt FROM lg GROUP BY feature, value), "
        f"rk AS (SELECT feature, value, cnt, (sum(cnt) OVER (PARTITION BY feature ORDER BY value) - cnt) "
        f"+ (cnt + 1) / 2.0 AS avg_rank, sum(cnt) OVER (PARTITION BY feature) AS n FROM pv), "
        f"g AS (SELECT lg.feature, lg.Quality_Class, sum(rk.avg_rank) AS r, count(*) AS nj, max(rk.n) AS n "
        f"FROM lg JOIN rk ON lg.feature = rk.feature AND lg.value = rk.value GROUP BY lg.feature, lg.Quality_Class), "
        f"f AS (SELECT feature, sum(r * r / nj) AS ssq, max(n) AS n, count(*) AS k FROM g GROUP BY feature), "
        f"t AS (SELECT feature, sum(power(CAST(cnt AS DOUBLE), 3) - cnt) AS tie_sum FROM rk GROUP BY feature), "
        f"h AS (SELECT f.feature, (12.0 / (n * (n + 1.0)) * ssq - 3.0 * (n + 1.0)) / "
        f"(1.0 - tie_sum / (power(CAST(n AS DOUBLE), 3) - n)) AS kruskal_statistic, CAST(k - 1 AS INTEGER) AS degrees_of_freedom "
        f"FROM f JOIN t USING (feature) WHERE k >= 2 AND (1.0 - tie_sum / (power(CAST(n AS DOUBLE), 3) - n)) > 0) "
        f"SELECT feature, kruskal_statistic, degrees_of_freedom, p_value, "
        f"CASE WHEN p_value >= {THRESHOLDS['kruskal_alpha']} THEN {q(TEXT['sep_weak'])} "
        f"ELSE {q(TEXT['sep_yes'])} END AS class_separation_signal FROM (SELECT *, {chi2_tail_sql()} AS p_value FROM h)"
    )


def defect_trend_sql() -> str:
    dom = ", ".join(f"({q(v)}, {i})" for i, v in enumerate(QUALITY_ORDER))
    med = quantiles_sql_parts("(SELECT Quality_Class, CAST(Defect_Count AS DOUBLE) AS v FROM builds "
                              "WHERE Quality_Class IS NOT NULL)", ["Quality_Class"], "v", {"median": 0.5})
    return (
        f"WITH d AS (SELECT * FROM (VALUES {dom}) d(Quality_Class, o)), "
        f"s AS (SELECT Quality_Class, count(Defect_Count) AS count, avg(CAST(Defect_Count AS DOUBLE)) AS mean, "
        f"stddev_samp(CAST(Defect_Count AS DOUBLE)) AS std FROM builds WHERE Quality_Class IS NOT NULL GROUP BY Quality_Class), "
        f"m AS ({med}), "
        f"t AS (SELECT d.Quality_Class, d.o, CAST(s.count AS BIGINT) AS count, s.mean, m.median, s.std FROM d "
        f"LEFT JOIN s ON d.Quality_Class = s.Quality_Class LEFT JOIN m ON d.Quality_Class = m.Quality_Class), "
        f"r AS (SELECT *, CASE WHEN mean > last_value(mean IGNORE NULLS) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS rise FROM t) "
        f"SELECT Quality_Class, count, mean, median, std, CASE WHEN max(rise) OVER () > 0 THEN {q(TEXT['trend_warn'])} "
        f"ELSE {q(TEXT['trend_pass'])} END AS trend_check FROM r"
    )


def leakage_identifiers_sql(actual: list[str]) -> str:
    rows = []
    for c in actual:
        if c in IDENTIFIER_COLUMNS:
            rows.append((c, TEXT["id_leak"], TEXT["id_rec"]))
        if c in POST_BUILD:
            rows.append((c, TEXT["timing_leak"], TEXT["timing_rec"]))
    vals = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {vals}) l(feature, risk_type, recommendation)"


def challenge_bundle_sql(actual: list[str]) -> str:
    def part(name, body, item, value, label):
        v = f"CAST({value} AS DOUBLE)" if value else "CAST(NULL AS DOUBLE)"
        return (f"SELECT {q(name)} AS report, CAST({item} AS VARCHAR) AS item, {v} AS value, "
                f"CAST({label} AS VARCHAR) AS label FROM ({body}) x_{name}")
    return union_all([
        part("distribution_challenge", distribution_challenge_sql(), "feature", "uniformity_score", "interpretation"),
        part("physics_correlation_challenge", physics_correlations_sql(), "relationship", "correlation", "interpretation"),
        part("energy_density_formula_challenge", energy_formula_sql(), '"check"', "correlation_observed_vs_calculated",
             "status"),
        part("quality_separation_challenge", kruskal_sql(), "feature", "kruskal_statistic", "class_separation_signal"),
        part("defect_trend_challenge", defect_trend_sql(), "Quality_Class", "mean", "trend_check"),
        part("leakage_challenge", leakage_identifiers_sql(actual), "feature", None, "risk_type"),
    ])


def realism_scorecard_sql(actual: list[str]) -> str:
    return (
        f"WITH dc AS ({distribution_challenge_sql()}), ef AS ({energy_formula_sql()}), pc AS ({physics_correlations_sql()}), "
        f"ks AS ({kruskal_sql()}), lk AS ({leakage_identifiers_sql(actual)}) "
        f"SELECT 'Distribution realism' AS challenge, printf('%d highly uniform variables', "
        f"(SELECT count(*) FROM dc WHERE uniformity_score >= {THRESHOLDS['uniform']})) AS result "
        f"UNION ALL SELECT 'Energy-density formula', (SELECT CASE WHEN correlation_observed_vs_calculated IS NULL "
        f"THEN 'N/A' ELSE printf('corr=%.3f, MAPE=%.1f%%', correlation_observed_vs_calculated, "
        f"mean_absolute_percent_error) END FROM ef) "
        f"UNION ALL SELECT 'Expected physics correlations', printf('%d/%d weak', (SELECT count(*) FROM pc WHERE "
        f"absolute_correlation < {THRESHOLDS['weak_correlation']}), (SELECT count(*) FROM pc)) "
        f"UNION ALL SELECT 'Quality class separation', printf('%d/%d weak', (SELECT count(*) FROM ks WHERE "
        f"class_separation_signal = {q(TEXT['sep_weak'])}), (SELECT count(*) FROM ks)) "
        f"UNION ALL SELECT 'Quick RF predictability', 'N/A' "
        f"UNION ALL SELECT 'Timing / identifier leakage', printf('%d columns flagged', (SELECT count(*) FROM lk))"
    )


def numeric_summary_sql(cols=NUMERIC) -> str:
    lg = f"(SELECT * FROM ({long_sql(cols)}) l0 WHERE value IS NOT NULL AND NOT isnan(value))"
    qs = quantiles_sql_parts("lg", ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return (f"WITH lg AS {lg}, qs AS ({qs}) SELECT b.feature, count, mean, std, min, p25, p50, p75, max FROM "
            f"(SELECT feature, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, "
            f"max(value) AS max FROM lg GROUP BY feature) b JOIN qs ON b.feature = qs.feature")


def categorical_summary_sql(cols=CATEGORICAL + [TARGET]) -> str:
    parts = [f"SELECT {q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM builds GROUP BY {c}"
             for c in cols]
    return (f"SELECT \"column\", value, count, round_even(count / (SELECT count(*) FROM builds) * 100.0, 2) AS percent "
            f"FROM ({union_all(parts)}) c")


def box_stats_sql(cols=SAFE_NUMERIC) -> str:
    lg = (f"(SELECT * FROM ({long_sql(cols, 'lb', keep=['Quality_Class'])}) l0 WHERE value IS NOT NULL AND NOT isnan(value))")
    qs = quantiles_sql_parts("lg", ["feature", "Quality_Class"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return (
        f"WITH lb AS (SELECT * FROM builds WHERE Quality_Class IS NOT NULL), lg AS {lg}, qs AS ({qs}), "
        f"fe AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM qs) "
        f"SELECT fe.feature, fe.Quality_Class, count(*) AS n, q1, median, q3, iqr, "
        f"min(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_low, "
        f"max(CASE WHEN value >= lo_f AND value <= hi_f THEN value END) AS whisker_high, "
        f"count(*) FILTER (WHERE NOT (value >= lo_f AND value <= hi_f)) AS outliers "
        f"FROM lg JOIN fe ON lg.feature = fe.feature AND lg.Quality_Class = fe.Quality_Class "
        f"GROUP BY fe.feature, fe.Quality_Class, q1, median, q3, iqr"
    )


def category_by_class_sql(cols=CATEGORICAL) -> str:
    parts = [f"SELECT {q(c)} AS variable, CAST({c} AS VARCHAR) AS category, Quality_Class FROM builds" for c in cols]
    piv = ", ".join(f"CAST(count(*) FILTER (WHERE Quality_Class = {q(v)}) AS BIGINT) AS {v}" for v in QUALITY_ORDER)
    return f"SELECT variable, category, {piv} FROM ({union_all(parts)}) l GROUP BY variable, category"


def class_distribution_sql() -> str:
    dom = ", ".join(f"({q(v)}, {i + 1})" for i, v in enumerate(QUALITY_ORDER))
    return (
        f"WITH d AS (SELECT * FROM (VALUES {dom}) d(Quality_Class, class_order)), "
        f"c AS (SELECT Quality_Class, count(*) AS count FROM builds GROUP BY Quality_Class), "
        f"p AS (SELECT min(count) AS mn, max(count) AS mx FROM c JOIN d USING (Quality_Class)) "
        f"SELECT d.Quality_Class, d.class_order, CAST(coalesce(c.count, 0) AS BIGINT) AS count, "
        f"coalesce(c.count, 0) / (SELECT count(*) FROM builds) AS share, CAST(p.mx AS DOUBLE) / NULLIF(p.mn, 0) "
        f"AS imbalance_ratio FROM d LEFT JOIN c ON d.Quality_Class = c.Quality_Class, p"
    )


def quality_audit_sql(actual: list[str]) -> str:
    return (
        f"WITH sr AS ({schema_report_sql(actual)}), mv AS ({missing_values_sql(actual)}), "
        f"dr AS ({duplicate_rows_sql(actual)}), pr AS ({physical_ranges_sql()}), cf AS ({constant_features_sql(actual)}), "
        f"v AS (SELECT (SELECT count(*) FROM sr WHERE status = 'FAIL') AS f, (SELECT count(*) FROM sr WHERE status = 'WARN') AS w, "
        f"(SELECT coalesce(sum(missing_count), 0) FROM mv) AS m, (SELECT coalesce(sum(duplicate_count), 0) FROM dr) AS d, "
        f"(SELECT coalesce(sum(invalid_count), 0) FROM pr) AS p, (SELECT count(*) FROM cf WHERE status = 'WARN') AS c) "
        f"SELECT 1 AS pos, 'Schema validation' AS \"check\", CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END "
        f"AS status, CASE WHEN f + w = 0 THEN 'Expected columns available' ELSE printf('%d missing, %d unexpected columns', f, w) "
        f"END AS detail FROM v "
        f"UNION ALL SELECT 2, 'Missing values', CASE WHEN m = 0 THEN 'PASS' ELSE 'WARN' END, CAST(m AS VARCHAR) FROM v "
        f"UNION ALL SELECT 3, 'Duplicate rows', CASE WHEN d = 0 THEN 'PASS' ELSE 'WARN' END, CAST(d AS VARCHAR) FROM v "
        f"UNION ALL SELECT 4, 'Invalid physical ranges', CASE WHEN p = 0 THEN 'PASS' ELSE 'WARN' END, CAST(p AS VARCHAR) FROM v "
        f"UNION ALL SELECT 5, 'Constant / near-constant features', CASE WHEN c = 0 THEN 'PASS' ELSE 'WARN' END, "
        f"CAST(c AS VARCHAR) FROM v"
    )


def feature_group_sql_expr(c: str = "feature") -> str:
    def lst(xs):
        return ", ".join(q(x) for x in xs)
    return (f"CASE WHEN {c} IN ({lst(POST_BUILD)}) THEN {q(FEATURE_GROUP_LABELS['post'])} "
            f"WHEN {c} IN ({lst(PROCESS)}) THEN {q(FEATURE_GROUP_LABELS['process'])} "
            f"WHEN {c} IN ({lst(CATEGORICAL)}) THEN {q(FEATURE_GROUP_LABELS['categorical'])} "
            f"ELSE {q(FEATURE_GROUP_LABELS['other'])} END")


def feature_groups_sql(cols=EXPECTED_COLUMNS) -> str:
    parts = [f"SELECT {q(c)} AS feature, count({c}) AS non_null FROM builds" for c in cols]
    return f"SELECT feature, non_null, {feature_group_sql_expr()} AS feature_group FROM ({union_all(parts)}) g"


def risk_ranking_sql(actual: list[str]) -> str:
    sev = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SEVERITY_SCORE.items())
    imp = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in RISK_IMPACT.items())
    return (f"SELECT risk, severity, coalesce(CASE severity {sev} END, 0) AS severity_score, "
            f"coalesce(CASE risk {imp} END, {q(RISK_IMPACT_DEFAULT)}) AS impact, evidence, recommended_action "
            f"FROM ({production_risks_sql(actual)}) r")


register("uniformity_score", with_builds(
    "SELECT feature, nonempty_bins, CASE WHEN nonempty_bins <= 1 THEN 0.0 ELSE ent / ln(nonempty_bins) END AS uniformity_score "
    "FROM (SELECT h.feature, t.k AS nonempty_bins, -sum((count / n) * ln(count / n)) AS ent FROM (SELECT * FROM ("
    + histogram_sql(SAFE_NUMERIC, 20) + ") hh WHERE count > 0) h JOIN (SELECT feature, sum(count) AS n, count(*) AS k FROM ("
    + histogram_sql(SAFE_NUMERIC, 20) + ") h2 WHERE count > 0 GROUP BY feature) t ON h.feature = t.feature GROUP BY h.feature, t.k) u"))
register("distribution_challenge", with_builds(distribution_challenge_sql()))
register("physics_correlations", with_builds(physics_correlations_sql()))
register("energy_formula_check", with_builds(energy_formula_sql()))
register("kruskal_separation", with_builds(kruskal_sql()))
register("kruskal_p_values", with_builds(kruskal_sql()))
register("defect_trend", with_builds(defect_trend_sql()))
register("leakage_identifiers", with_builds(leakage_identifiers_sql(_C)))
register("challenge_bundle_without_model", with_builds(challenge_bundle_sql(_C)))
register("realism_scorecard_without_model", with_builds(realism_scorecard_sql(_C)))
register("numeric_summary", with_builds(numeric_summary_sql()))
register("categorical_summary", with_builds(categorical_summary_sql()))
register("histogram", with_builds(histogram_sql(SAFE_NUMERIC, 20)))
register("box_stats_by_class", with_builds(box_stats_sql()))
register("category_by_class", with_builds(category_by_class_sql()))
register("class_distribution", with_builds(class_distribution_sql()))
register("quality_audit", with_builds(quality_audit_sql(_C)))
register("top_outlier_features", with_builds(
    f"SELECT feature, outlier_count, outlier_percent FROM ({iqr_outliers_sql()}) o WHERE feature <> 'Sample_ID' "
    f"ORDER BY outlier_percent DESC, feature LIMIT 12"))
register("feature_group", with_builds(feature_groups_sql()))
register("top_mi_features", with_builds(
    f"SELECT feature, mutual_information_score, {feature_group_sql_expr()} AS feature_group FROM "
    f"({mutual_information_sql(_MI_NUM, CATEGORICAL)}) m ORDER BY mutual_information_score DESC, feature LIMIT 15"))
register("risk_ranking", with_builds(risk_ranking_sql(_C)))
register("energy_bin_risk", with_builds(
    "SELECT s.*, o.overall_risk_rate_percent FROM (" + binned_risk_sql([("Energy_Density_J_mm3", 8, "energy_bin")])
    + f") s, (SELECT 100.0 * sum({risk_sql()}) / count(*) AS overall_risk_rate_percent FROM builds "
      "WHERE Energy_Density_J_mm3 IS NOT NULL AND Quality_Class IS NOT NULL) o"))
register("category_risk", with_builds(
    "SELECT variable, category, samples, risk_count, risk_rate_percent, printf('%.1f%%', risk_rate_percent) AS risk_rate_label "
    "FROM (SELECT variable, category, count(*) AS samples, sum(r) AS risk_count, 100.0 * sum(r) / count(*) AS risk_rate_percent "
    "FROM (" + union_all([f"SELECT {q(c)} AS variable, CAST({c} AS VARCHAR) AS category, {risk_sql()} AS r FROM builds"
                          for c in CATEGORICAL]) + ") l WHERE category IS NOT NULL GROUP BY variable, category) c"))
register("process_window_pivot", with_builds(
    "SELECT power_bin, " + ", ".join(
        f"max(CASE WHEN speed_bin = {k} THEN risk_rate_percent END) AS rate_{k}, "
        f"max(CASE WHEN speed_bin = {k} THEN samples END) AS n_{k}" for k in range(1, 7))
    + " FROM (" + binned_risk_sql([("Laser_Power_W", 6, "power_bin"), ("Scan_Speed_mm_s", 6, "speed_bin")])
    + ") c GROUP BY power_bin"))


# ---------------------------------------------------------------------------
# projections, evaluation, selection (on SQL-reproducible candidate predictions)
# ---------------------------------------------------------------------------

from fusionlens.contract import MODEL_LADDER, SELECTION_POLICY  # noqa: E402
from fusionlens.functions.exprs import unit_hash_sql  # noqa: E402
from fusionlens.plans.candidates import CANDIDATES, RULES, TEST_SIZE  # noqa: E402

METRICS = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1",
           "risk_precision", "risk_recall", "risk_f1", "risk_f2"]


def predictions_sql() -> str:
    parts = []
    for scen, model in CANDIDATES:
        pred = "majority_class" if model == "dummy" else RULES[scen]
        parts.append(f"SELECT {q(scen)} AS scenario, {q(model)} AS model_type, Quality_Class AS label, "
                     f"{pred} AS prediction FROM s, maj WHERE is_test")
    return (f"WITH s AS (SELECT *, {unit_hash_sql('Sample_ID')} < {TEST_SIZE} AS is_test FROM builds "
            f"WHERE Quality_Class IS NOT NULL), "
            f"maj AS (SELECT Quality_Class AS majority_class FROM s WHERE NOT is_test GROUP BY Quality_Class "
            f"ORDER BY count(*) DESC, Quality_Class ASC LIMIT 1) {union_all(parts)}")


def _ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


def metrics_sql() -> str:
    """(scenario, model_type, 8 metrics) from the predictions."""
    risk = lambda c: f"CASE WHEN {c} IN ('Poor', 'Moderate') THEN 1 ELSE 0 END"
    return (
        f"WITH p AS ({predictions_sql()}), "
        f"cc AS (SELECT scenario, model_type, label AS actual, prediction AS predicted, CAST(count(*) AS DOUBLE) AS n "
        f"FROM p GROUP BY ALL), "
        f"cls AS (SELECT scenario, model_type, actual AS cls FROM cc UNION SELECT scenario, model_type, predicted FROM cc), "
        f"pc AS (SELECT c.scenario, c.model_type, c.cls, "
        f"coalesce((SELECT sum(n) FROM cc WHERE cc.scenario = c.scenario AND cc.model_type = c.model_type AND "
        f"cc.actual = c.cls AND cc.predicted = c.cls), 0.0) AS tp, "
        f"coalesce((SELECT sum(n) FROM cc WHERE cc.scenario = c.scenario AND cc.model_type = c.model_type AND "
        f"cc.actual = c.cls), 0.0) AS true_n, "
        f"coalesce((SELECT sum(n) FROM cc WHERE cc.scenario = c.scenario AND cc.model_type = c.model_type AND "
        f"cc.predicted = c.cls), 0.0) AS pred_n FROM cls c), "
        f"m AS (SELECT scenario, model_type, sum(tp) / sum(true_n) AS accuracy, "
        f"avg(CASE WHEN true_n > 0 THEN tp / true_n END) AS balanced_accuracy, "
        f"avg({_ratio_sql('2 * tp', 'true_n + pred_n')}) AS macro_f1, "
        f"{_ratio_sql(f'sum(({_ratio_sql(chr(50) + ' * tp', 'true_n + pred_n')}) * true_n)', 'sum(true_n)')} AS weighted_f1 "
        f"FROM pc GROUP BY scenario, model_type), "
        f"r AS (SELECT scenario, model_type, sum(CASE WHEN {risk('actual')} = 1 AND {risk('predicted')} = 1 THEN n ELSE 0.0 END) AS tp, "
        f"sum(CASE WHEN {risk('actual')} = 0 AND {risk('predicted')} = 1 THEN n ELSE 0.0 END) AS fp, "
        f"sum(CASE WHEN {risk('actual')} = 1 AND {risk('predicted')} = 0 THEN n ELSE 0.0 END) AS fn FROM cc GROUP BY ALL) "
        f"SELECT m.scenario, m.model_type, accuracy, balanced_accuracy, macro_f1, weighted_f1, "
        f"{_ratio_sql('tp', 'tp + fp')} AS risk_precision, {_ratio_sql('tp', 'tp + fn')} AS risk_recall, "
        f"{_ratio_sql('2 * tp', '2 * tp + fp + fn')} AS risk_f1, {_ratio_sql('5 * tp', '5 * tp + 4 * fn + fp')} AS risk_f2 "
        f"FROM m JOIN r ON m.scenario = r.scenario AND m.model_type = r.model_type"
    )


POLICY_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({q(s)}, {q(p)}, {q(x)}, {a}, {b}, {q(r)})" for s, (p, x, a, b, r) in SELECTION_POLICY.items()
) + ") v(scenario, primary_metric, secondary_metric, minimum_primary_lift, minimum_secondary_lift, business_reason)) pol"
LADDER_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({q(m)}, {q(f)}, {lv}, {q(role)}, {q(ask)})" for m, (f, lv, role, ask) in MODEL_LADDER.items()
) + ") v(model_type, model_family, complexity_level, business_role, improvement_question)) lad"


def metric_pick(name_col: str) -> str:
    return "CASE " + " ".join(f"WHEN {name_col} = {q(m)} THEN {m}" for m in METRICS) + " END"


def comparison_sql() -> str:
    return (f"SELECT m.scenario, m.model_type, lad.model_family, CAST(lad.complexity_level AS INTEGER) AS complexity_level, "
            f"{', '.join('m.' + x for x in METRICS)}, pol.primary_metric AS selection_primary_metric, "
            f"pol.secondary_metric AS selection_secondary_metric, pol.business_reason AS business_selection_reason, "
            f"lad.business_role, lad.improvement_question "
            f"FROM ({metrics_sql()}) m LEFT JOIN {LADDER_SQL} ON m.model_type = lad.model_type "
            f"LEFT JOIN {POLICY_SQL} ON m.scenario = pol.scenario")


def recommendation_sql() -> str:
    return (
        f"WITH c AS (SELECT cmp.*, pol.primary_metric, pol.secondary_metric, pol.minimum_primary_lift, "
        f"pol.minimum_secondary_lift, pol.business_reason FROM ({comparison_sql()}) cmp JOIN {POLICY_SQL} "
        f"ON cmp.scenario = pol.scenario), "
        f"c2 AS (SELECT *, {metric_pick('primary_metric')} AS pv, {metric_pick('secondary_metric')} AS sv FROM c), "
        f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY pv DESC, sv DESC, model_type) AS rn "
        f"FROM c2) x WHERE rn = 1), "
        f"d AS (SELECT scenario, pv AS dpv, sv AS dsv FROM (SELECT *, row_number() OVER (PARTITION BY scenario "
        f"ORDER BY pv DESC, sv DESC) AS rn FROM c2 WHERE model_type = 'dummy') y WHERE rn = 1) "
        f"SELECT b.scenario, model_type AS best_model_type, model_family AS best_model_family, "
        f"primary_metric AS selection_primary_metric, secondary_metric AS selection_secondary_metric, "
        f"pv AS best_primary_metric_value, sv AS best_secondary_metric_value, dpv AS dummy_primary_metric_value, "
        f"dsv AS dummy_secondary_metric_value, pv - dpv AS primary_metric_lift_over_dummy, "
        f"sv - dsv AS secondary_metric_lift_over_dummy, "
        f"CASE WHEN dpv IS NULL THEN 'REVIEW_REQUIRED' WHEN pv - dpv < minimum_primary_lift OR sv - dsv < "
        f"minimum_secondary_lift THEN 'NOT_RECOMMENDED_FOR_DEPLOYMENT' ELSE 'CANDIDATE_FOR_ENGINEERING_VALIDATION' END "
        f"AS deployment_status, business_reason AS business_selection_reason, "
        f"CASE WHEN dpv IS NULL THEN {q(TEXT['review'])} WHEN pv - dpv < minimum_primary_lift OR sv - dsv < "
        f"minimum_secondary_lift THEN {q(TEXT['not_recommended'])} ELSE {q(TEXT['candidate'])} END AS recommendation "
        f"FROM b LEFT JOIN d ON b.scenario = d.scenario"
    )


def best_per_scenario_sql() -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY macro_f1 DESC, "
            f"balanced_accuracy DESC, model_type) AS rn FROM ({comparison_sql()}) c) x WHERE rn = 1")


_CMP = comparison_sql()
register("scenario_view", with_builds(f"SELECT {', '.join(scenario_columns('inbuild'))} FROM builds"))
register("model_frame", with_builds(f"SELECT {', '.join(scenario_columns('prebuild') + [TARGET])} FROM builds"))
register("safe_features", with_builds(
    f"SELECT {', '.join(usable_columns(_C + ['event_time', 'machine_id']))} FROM builds", with_extras=True))
register("quality_ordinal", with_builds(f"SELECT Sample_ID, Quality_Class, {ORDINAL_SQL} AS Quality_Class_numeric FROM builds"))
register("risk_flag", with_builds(f"SELECT Sample_ID, Quality_Class, {risk_sql()} AS is_risk_class FROM builds"))
register("complete_cases", with_builds(
    "SELECT Laser_Power_W, Scan_Speed_mm_s, Energy_Density_J_mm3, Quality_Class FROM builds WHERE Laser_Power_W IS NOT NULL "
    "AND Scan_Speed_mm_s IS NOT NULL AND Energy_Density_J_mm3 IS NOT NULL AND Quality_Class IS NOT NULL"))
register("labelled_rows", with_builds("SELECT * FROM builds WHERE Quality_Class IS NOT NULL"))
register("energy_density_calc", with_builds(
    "SELECT Sample_ID, Energy_Density_J_mm3, Laser_Power_W / NULLIF(Scan_Speed_mm_s * Hatch_Spacing_mm * "
    "(Layer_Thickness_um / 1000.0), 0) AS calculated_energy_density FROM builds"))
register("stratified_split", with_builds(
    "SELECT Quality_Class, CASE WHEN rn <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split, count(*) AS rows "
    "FROM (SELECT Quality_Class, row_number() OVER (PARTITION BY Quality_Class ORDER BY md5(CAST(Sample_ID AS VARCHAR) "
    "|| '|42')) AS rn, count(*) OVER (PARTITION BY Quality_Class) AS n FROM builds) s GROUP BY ALL"))
register("class_weights", with_builds(
    "SELECT Quality_Class, count(*) AS rows, max(w) AS class_weight FROM (SELECT b.Quality_Class, "
    "n / (k * nc) AS w FROM builds b JOIN (SELECT Quality_Class, count(*) AS nc FROM builds GROUP BY Quality_Class) c "
    "ON b.Quality_Class = c.Quality_Class, (SELECT count(*) AS n, count(DISTINCT Quality_Class) AS k FROM builds) t) x "
    "GROUP BY Quality_Class"))
register("model_dummy", with_builds(
    f"SELECT scenario, label, prediction, count(*) AS rows FROM ({predictions_sql()}) p WHERE model_type = 'dummy' "
    f"GROUP BY ALL"))
register("confusion_matrix", with_builds(
    "WITH p AS (" + predictions_sql() + "), k AS (SELECT DISTINCT scenario, model_type FROM p), "
    "g AS (SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {i}, {j})" for i, a in enumerate(QUALITY_ORDER)
                                              for j, b in enumerate(QUALITY_ORDER))
    + ") g(actual, predicted, actual_order, predicted_order)) "
    "SELECT k.scenario, k.model_type, g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count, actual_order, "
    "predicted_order FROM k, g LEFT JOIN (SELECT scenario, model_type, label, prediction, count(*) AS n FROM p GROUP BY ALL) c "
    "ON c.scenario = k.scenario AND c.model_type = k.model_type AND c.label = g.actual AND c.prediction = g.predicted"))
register("classification_metrics", with_builds(metrics_sql()))
register("risk_metrics", with_builds(
    "SELECT scenario, model_type, risk_precision, risk_recall, risk_f1, risk_f2 FROM (" + metrics_sql() + ") m"))
register("per_class_metrics", with_builds(
    "WITH p AS (" + predictions_sql() + "), k AS (SELECT DISTINCT scenario, model_type FROM p), "
    "d AS (SELECT * FROM (VALUES " + ", ".join(f"({q(v)}, {i})" for i, v in enumerate(QUALITY_ORDER))
    + ") d(label, class_order)), x AS (SELECT k.scenario, k.model_type, d.label, d.class_order, "
    "CAST((SELECT count(*) FROM p WHERE p.scenario = k.scenario AND p.model_type = k.model_type AND p.label = d.label "
    "AND p.prediction = d.label) AS DOUBLE) AS tp, CAST((SELECT count(*) FROM p WHERE p.scenario = k.scenario AND "
    "p.model_type = k.model_type AND p.label = d.label) AS DOUBLE) AS true_n, CAST((SELECT count(*) FROM p WHERE "
    "p.scenario = k.scenario AND p.model_type = k.model_type AND p.prediction = d.label) AS DOUBLE) AS pred_n FROM k, d) "
    f"SELECT scenario, model_type, label, class_order, {_ratio_sql('tp', 'pred_n')} AS precision, "
    f"{_ratio_sql('tp', 'true_n')} AS recall, {_ratio_sql('2 * tp', 'true_n + pred_n')} AS f1, "
    f"CAST(true_n AS BIGINT) AS support FROM x"))
register("compare_models", with_builds(_CMP))
register("recommendation", with_builds(recommendation_sql()))
register("best_per_scenario", with_builds(best_per_scenario_sql()))
register("scenario_summary_join", with_builds(
    "SELECT b.*, r.best_model_type, r.best_model_family, r.selection_primary_metric AS selection_primary_metric_recommendation, "
    "r.selection_secondary_metric AS selection_secondary_metric_recommendation, r.best_primary_metric_value, "
    "r.best_secondary_metric_value, r.dummy_primary_metric_value, r.dummy_secondary_metric_value, "
    "r.primary_metric_lift_over_dummy, r.secondary_metric_lift_over_dummy, r.deployment_status, "
    "r.business_selection_reason AS business_selection_reason_recommendation, r.recommendation "
    f"FROM ({best_per_scenario_sql()}) b LEFT JOIN ({recommendation_sql()}) r ON b.scenario = r.scenario"))
register("model_ladder", with_builds(f"SELECT DISTINCT model_type, model_family, complexity_level FROM ({_CMP}) c"))
register("comparison_union", with_builds(_CMP))
register("comparison_sorted", with_builds(_CMP))
register("operational_subset", with_builds(f"SELECT * FROM ({_CMP}) c WHERE scenario IN ('prebuild', 'inbuild')"))
register("selection_display", with_builds(
    f"SELECT c.scenario, model_type, pol.primary_metric, {metric_pick('pol.primary_metric')} AS primary_value, "
    f"pol.secondary_metric, {metric_pick('pol.secondary_metric')} AS secondary_value, balanced_accuracy, macro_f1 "
    f"FROM ({_CMP}) c JOIN {POLICY_SQL} ON c.scenario = pol.scenario"))
register("risk_f2_pivot", with_builds(
    "SELECT scenario, max(CASE WHEN model_type = 'dummy' THEN risk_f2 END) AS dummy, "
    "max(CASE WHEN model_type = 'rule_baseline' THEN risk_f2 END) AS rule_baseline "
    f"FROM ({_CMP}) c WHERE scenario IN ('prebuild', 'inbuild') GROUP BY scenario"))
register("inbuild_tradeoff", with_builds(
    f"SELECT model_type, risk_f2, macro_f1 FROM ({_CMP}) c WHERE scenario = 'inbuild' AND model_type IN ('dummy', 'rule_baseline')"))
register("process_points", with_builds(
    f"SELECT Sample_ID, Scan_Speed_mm_s, Laser_Power_W, Quality_Class FROM builds"))


# ---------------------------------------------------------------------------
# scoring and sources
# ---------------------------------------------------------------------------

REQ = scenario_columns('inbuild')
_MISSING = ("concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN {q(c)} END" for c in REQ) + ")")
_SCORING_FRAME = (f"SELECT Sample_ID, {', '.join(REQ)}, {_MISSING} AS missing_fields, "
                  f"({' AND '.join(f'{c} IS NOT NULL' for c in REQ)}) AS is_valid FROM builds")
register("scoring_frame", with_builds(_SCORING_FRAME))
register("source_scoring_json", with_builds(_SCORING_FRAME))
register("score_rejects", f"SELECT * FROM ({SQL['source_scoring_json']}) r WHERE NOT is_valid")
register("recommended_action", with_builds(
    f"SELECT scenario, prediction AS predicted_quality_class, CASE WHEN prediction IN ('Poor', 'Moderate') THEN "
    f"{q(TEXT['action_escalate'])} WHEN (CASE WHEN prediction = 'Good' THEN 0.45 END) >= {THRESHOLDS['watch_probability']} "
    f"THEN {q(TEXT['action_watch'])} ELSE {q(TEXT['action_continue'])} END AS recommended_action, count(*) AS rows "
    f"FROM ({predictions_sql()}) p WHERE model_type = 'rule_baseline' GROUP BY ALL"))
register("scan_csv_contract", with_builds("SELECT * FROM builds"))
register("source_report", with_builds(missing_values_sql()))
register("sink_confusion_csv", with_builds(
    "WITH p AS (" + predictions_sql() + ") SELECT scenario, model_type, 'actual_' || a.actual AS actual, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE p.label = a.actual AND p.prediction = {q(v)}) AS BIGINT) AS predicted_{v}"
                for v in QUALITY_ORDER)
    + " FROM (SELECT DISTINCT scenario AS s, model_type AS m FROM p) k, (SELECT * FROM (VALUES "
    + ", ".join(f"({q(v)})" for v in QUALITY_ORDER) + ") v(actual)) a JOIN p ON p.scenario = k.s AND p.model_type = k.m "
    "GROUP BY scenario, model_type, a.actual"))


# ---------------------------------------------------------------------------
# monitoring batch twins
# ---------------------------------------------------------------------------

from fusionlens.streaming.monitoring import DRIFT_FEATURES, INBUILD_RULE, PSI_BINS, PSI_FLOOR  # noqa: E402

WB = "time_bucket(INTERVAL '30 days', event_time, TIMESTAMP '1970-01-01')"


def quality_drift_sql() -> str:
    return (f"SELECT ws AS window_start, ws + INTERVAL '30 days' AS window_end, samples, risk_rate_percent, "
            f"baseline_risk_rate_percent, risk_rate_percent - baseline_risk_rate_percent AS delta_percent_points FROM "
            f"(SELECT {WB} AS ws, count(*) AS samples, 100.0 * sum({risk_sql()}) / count(*) AS risk_rate_percent "
            f"FROM builds WHERE Quality_Class IS NOT NULL GROUP BY ws) w, (SELECT 100.0 * sum({risk_sql()}) / count(*) "
            f"AS baseline_risk_rate_percent FROM builds WHERE Quality_Class IS NOT NULL) b")


def psi_sql() -> str:
    lb = union_all([f"SELECT {q(c)} AS feature, CAST({c} AS DOUBLE) AS value, {WB} AS ws FROM builds WHERE {c} IS NOT NULL"
                    for c in DRIFT_FEATURES])
    return (
        f"WITH l AS ({lb}), r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY feature), "
        f"bl AS (SELECT l.*, {edge_bin_sql('l.value', 'r.lo', 'r.hi', PSI_BINS, False)} AS bin FROM l JOIN r USING (feature)), "
        f"bs0 AS (SELECT feature, bin, count(*) AS c0 FROM bl GROUP BY feature, bin), "
        f"bs AS (SELECT feature, bin, c0 / sum(c0) OVER (PARTITION BY feature) AS b FROM bs0), "
        f"wc AS (SELECT ws, feature, bin, count(*) AS c FROM bl GROUP BY ALL), "
        f"tot AS (SELECT ws, feature, sum(c) AS n FROM wc GROUP BY ALL), "
        f"g AS (SELECT ws, feature, n, unnest(range(1, {PSI_BINS + 1})) AS bin FROM tot), "
        f"f AS (SELECT g.ws, g.feature, greatest(coalesce(wc.c, 0) / g.n, {PSI_FLOOR}) AS a, "
        f"greatest(coalesce(bs.b, 0.0), {PSI_FLOOR}) AS b FROM g LEFT JOIN wc ON g.ws = wc.ws AND g.feature = wc.feature "
        f"AND g.bin = wc.bin LEFT JOIN bs ON g.feature = bs.feature AND g.bin = bs.bin) "
        f"SELECT ws AS window_start, feature, sum((a - b) * ln(a / b)) AS psi FROM f GROUP BY ws, feature"
    )


register("quality_drift_window", with_builds(quality_drift_sql(), with_extras=True))
register("inspection_drift_window", with_builds(
    f"SELECT {WB} AS window_start, {WB} + INTERVAL '30 days' AS window_end, count(*) AS samples, "
    f"avg(Porosity_percent) AS mean_porosity_percent, avg(Relative_Density_percent) AS mean_relative_density_percent, "
    f"avg(Defect_Count) AS mean_defect_count FROM builds GROUP BY ALL", with_extras=True))
register("process_drift_psi", with_builds(psi_sql(), with_extras=True))
register("prediction_mix_drift_rule", with_builds(
    f"SELECT {WB} AS window_start, {WB} + INTERVAL '30 days' AS window_end, count(*) AS samples, "
    + ", ".join(f"count(*) FILTER (WHERE ({INBUILD_RULE}) = {q(v)}) / count(*) AS share_{v}" for v in QUALITY_ORDER)
    + " FROM builds GROUP BY ALL", with_extras=True))
from fusionlens.plans.candidates import CHECK_PSI, CHECK_RISK_DELTA  # noqa: E402

register("drift_alerts", with_builds(
    f"SELECT window_start, 'quality_risk_rate' AS signal, delta_percent_points AS value, {CHECK_RISK_DELTA} AS threshold "
    f"FROM ({quality_drift_sql()}) qd WHERE abs(delta_percent_points) > {CHECK_RISK_DELTA} UNION ALL "
    f"SELECT window_start, 'psi:' || feature, psi, {CHECK_PSI} FROM ({psi_sql()}) p WHERE psi > {CHECK_PSI}",
    with_extras=True))
_K = "machine_id ORDER BY event_time RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW"
_X = "(Melt_Pool_Temp_C - sh)"
register("rolling_sensor_stats", with_builds(
    "SELECT machine_id, event_time, Melt_Pool_Temp_C, n AS rolling_count, s1 / n + sh AS rolling_mean, "
    "CASE WHEN n > 1 THEN sqrt(greatest((s2 - n * power(s1 / n, 2)) / (n - 1), 0.0)) END AS rolling_std, "
    "mx / NULLIF(s1 / n + sh, 0) AS peak_to_average, "
    "CASE WHEN n >= 4 AND s2 / n - power(s1 / n, 2) > 1e-12 * (s2 / n) THEN ((n + 1.0) * (n - 1.0) * ((s4 / n - 4 * (s1 / n) "
    "* s3 / n + 6 * power(s1 / n, 2) * s2 / n - 3 * power(s1 / n, 4)) / power(s2 / n - power(s1 / n, 2), 2)) "
    "- 3 * power(n - 1.0, 2)) / ((n - 2.0) * (n - 3.0)) END AS rolling_kurtosis FROM ("
    "SELECT machine_id, event_time, Melt_Pool_Temp_C, sh, "
    f"count(Melt_Pool_Temp_C) OVER (PARTITION BY {_K}) AS n, sum({_X}) OVER (PARTITION BY {_K}) AS s1, "
    f"sum(power({_X}, 2)) OVER (PARTITION BY {_K}) AS s2, sum(power({_X}, 3)) OVER (PARTITION BY {_K}) AS s3, "
    f"sum(power({_X}, 4)) OVER (PARTITION BY {_K}) AS s4, max(Melt_Pool_Temp_C) OVER (PARTITION BY {_K}) AS mx "
    "FROM builds, (SELECT floor(avg(Melt_Pool_Temp_C)) AS sh FROM builds WHERE Melt_Pool_Temp_C IS NOT NULL "
    "AND event_time IS NOT NULL) c WHERE Melt_Pool_Temp_C IS NOT NULL AND event_time IS NOT NULL) r", with_extras=True))
register("physics_features", with_builds(
    "SELECT Sample_ID, Laser_Power_W / NULLIF(Scan_Speed_mm_s * Hatch_Spacing_mm * (Layer_Thickness_um / 1000.0), 0) "
    "AS energy_density_calc, Laser_Power_W / NULLIF(Scan_Speed_mm_s, 0) AS power_speed_ratio, "
    "Laser_Power_W / NULLIF(Scan_Speed_mm_s, 0) AS linear_heat_input_J_mm, "
    "Melt_Pool_Depth_um / NULLIF(Melt_Pool_Width_um, 0) AS melt_pool_aspect_ratio, "
    "Cooling_Rate_K_s / NULLIF(Thermal_Gradient, 0) AS cooling_to_gradient_ratio, "
    "concat_ws('|', Scan_Strategy, CAST(CAST(floor(Laser_Power_W / 50) * 50 AS BIGINT) AS VARCHAR)) AS strategy_power_window "
    "FROM builds"))


def correlation_matrix_sql(cols=NUMERIC) -> str:
    from itertools import combinations
    pairs = list(combinations(cols, 2))
    diag = union_all([f"SELECT {q(c)} AS feature_a, {q(c)} AS feature_b, CASE WHEN min({c}) < max({c}) THEN 1.0 END "
                      f"AS correlation FROM builds" for c in cols])
    return (f"WITH l AS ({correlation_long_sql(pairs)}) SELECT feature_a, feature_b, correlation FROM l UNION ALL "
            f"SELECT feature_b, feature_a, correlation FROM l UNION ALL {diag}")


def dataset_overview_sql(actual: list[str]) -> str:
    num = len([c for c in NUMERIC if c in actual])
    facts = [("Columns", str(len(actual))), ("Target", TARGET), ("Target classes", ", ".join(QUALITY_ORDER)),
             ("Numeric columns", str(num)), ("Categorical columns", str(len(actual) - num)),
             ("Material / categorical features", str(len(CATEGORICAL))),
             ("Process / monitoring features", str(len(PROCESS))),
             ("Post-build diagnostic features", str(len(POST_BUILD)))]
    rest = " ".join(f"UNION ALL SELECT {i + 2}, {q(a)}, {q(b)}" for i, (a, b) in enumerate(facts))
    return f"SELECT 1 AS pos, 'Rows' AS item, format('{{:,}}', count(*)) AS value FROM builds {rest}"


register("correlation_matrix", with_builds(correlation_matrix_sql()))
register("dataset_overview", with_builds(dataset_overview_sql(_C)))
register("selection_policy", with_builds(
    f"SELECT c.scenario, count(*) AS candidates, any_value(pol.primary_metric) AS primary_metric, "
    f"any_value(pol.secondary_metric) AS secondary_metric, any_value(pol.minimum_primary_lift) AS minimum_primary_lift, "
    f"any_value(pol.minimum_secondary_lift) AS minimum_secondary_lift, any_value(pol.business_reason) AS business_reason "
    f"FROM ({_CMP}) c JOIN {POLICY_SQL} ON c.scenario = pol.scenario GROUP BY c.scenario"))

from fusionlens.streaming.monitoring import DEBOUNCE_WINDOWS, WINDOW_SECONDS  # noqa: E402

register("alert_debounce", with_builds(
    f"WITH a AS (SELECT window_start, 'quality_risk_rate' AS signal, delta_percent_points AS value FROM "
    f"({quality_drift_sql()}) qd WHERE abs(delta_percent_points) > {CHECK_RISK_DELTA} UNION ALL "
    f"SELECT window_start, 'psi:' || feature, psi FROM ({psi_sql()}) p WHERE psi > {CHECK_PSI}), "
    f"i AS (SELECT *, CAST(floor(epoch(window_start) / {WINDOW_SECONDS}) AS BIGINT) - row_number() OVER "
    f"(PARTITION BY signal ORDER BY window_start) AS island FROM a), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY signal, island ORDER BY window_start) AS run_length FROM i) "
    f"SELECT window_start, signal, value, CAST(run_length AS INTEGER) AS run_length FROM r "
    f"WHERE run_length = {DEBOUNCE_WINDOWS}", with_extras=True))

# streams and sinks give what their batch forms give
register("quality_drift_stream", SQL["quality_drift_window"])
register("inspection_drift_stream", SQL["inspection_drift_window"])
register("process_drift_stream", with_builds(f"SELECT *, 1 AS baseline_version FROM ({psi_sql()}) p", with_extras=True))
register("prediction_mix_rule_stream", SQL["prediction_mix_drift_rule"])
register("alert_debounce_stream", SQL["alert_debounce"])
register("sink_metrics_json", SQL["classification_metrics"])
register("sink_reports", " UNION ALL ".join(
    f"SELECT '{name}' AS report, count(*) AS rows FROM ({sql}) r" for name, sql in (
        ("schema", with_builds(schema_report_sql(_C))), ("missing_values", SQL["missing_values"]),
        ("duplicates", SQL["duplicate_rows"]), ("physical_ranges", SQL["physical_ranges"]))))
register("run_audit", with_builds(
    f"SELECT (SELECT count(*) FROM builds) AS rows, {len(_C)} AS columns, g.* FROM "
    f"({gate_sql(data_quality_bundle_sql(_C))}) g"))
