"""Steps whose cost must grow no faster than the rows: weights, request parsing, tables read once, ranges."""

import glob

import pytest
from pyspark.sql import functions as F

from fusionlens.operators import evaluation, ml, quality, ranks, scoring, stats
from fusionlens.plans import registry
from fusionlens.sources import builds as source


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with small lineitem, orders and part tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    line = spark.range(240).selectExpr(
        "id div 4 AS l_orderkey", "id * 7 % 30 AS l_partkey", "id * 11 % 20 AS l_suppkey", "CAST(id % 4 + 1 AS INT) AS l_linenumber",
        "CAST(id * 13 % 50 + 1 AS DOUBLE) AS l_quantity", "900.5 + CAST(id * 37 % 1000 AS DOUBLE) * 40 AS l_extendedprice",
        "CAST(id % 11 AS DOUBLE) / 100 AS l_discount", "CAST(id % 9 AS DOUBLE) / 100 AS l_tax",
        "element_at(array('A', 'N', 'R'), CAST(id % 3 + 1 AS INT)) AS l_returnflag", "if(id % 2 = 0, 'F', 'O') AS l_linestatus",
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS l_shipdate")
    orders = spark.range(60).selectExpr(
        "id AS o_orderkey", "CAST(id * 101 % 977 AS DOUBLE) * 100 AS o_totalprice",
        "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), CAST(id % 5 + 1 AS INT)) AS o_orderpriority")
    part = spark.range(30).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size", "900.0D + id AS p_retailprice")
    for name, table in (("lineitem", line), ("orders", orders), ("part", part)):
        table.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_class_weights_do_not_deal_rows_by_class(spark):
    rows = spark.createDataFrame([(1, "Poor"), (2, "Good"), (3, "Good"), (4, None)], "Sample_ID long, Quality_Class string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        weighted = evaluation.class_weights(rows)
        assert "SortMergeJoin" not in plan_of(weighted)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["Sample_ID"]: r["class_weight"] for r in weighted.collect()} == {
        1: pytest.approx(4 / 3), 2: pytest.approx(4 / 6), 3: pytest.approx(4 / 6), 4: None}


def test_requests_are_parsed_once(spark):
    full = {c: ("x" if c in ("Alloy_Type", "Powder_Morphology", "Scan_Strategy") else 1.5) for c in scoring.REQUEST_COLUMNS}
    few = {k: v for k, v in full.items() if k != "Laser_Power_W"}
    rows = spark.createDataFrame([(1, full), (2, few)], "Sample_ID long, v struct<" + ", ".join(
        f"{c}: {'string' if isinstance(v, str) else 'double'}" for c, v in full.items()) + ">")
    raw = rows.select("Sample_ID", F.to_json("v").alias("value")).unionByName(
        spark.createDataFrame([(3, None), (4, "no json"), (5, "{}")], "Sample_ID long, value string"))
    rejected = scoring.reject_rows(scoring.parse_requests(raw))
    # one parse for each of the two branches of the union
    assert plan_of(rejected).count("from_json(") <= 2
    assert {r["Sample_ID"]: len(r["missing_fields"]) for r in rejected.collect()} == {2: 1, 3: 17, 4: 17, 5: 17}


@pytest.mark.parametrize("name, operator", [
    ("iqr_outliers", "stats.iqr_outliers"), ("mutual_information", "stats.mutual_information"), ("median_fill", "stats.median_fill"),
    ("mutual_information_neighbours", "stats.mutual_information_neighbours"), ("statistical_bundle", "stats.statistical_bundle"),
    ("quality_gate", "stats.statistical_bundle"), ("production_risks", "stats.iqr_outliers"), ("risk_ranking", "stats.iqr_outliers"),
    ("numeric_summary", "summary.numeric_summary"), ("box_stats_by_class", "summary.box_stats_by_class"),
    ("top_mi_features", "stats.mutual_information"), ("preprocess", "ml.with_class_weights"), ("training_pipeline", "ml.with_class_weights"),
    ("challenge_bundle_without_model", "challenge.challenge_reports"),
    ("realism_scorecard_without_model", "challenge.challenge_reports")])
def test_reports_of_many_scans_read_a_table_written_once(spark, tables, monkeypatch, name, operator):
    class Seen(Exception):
        pass

    def stop(df, *_):
        raise Seen(df.inputFiles())

    module, function = operator.split(".")
    monkeypatch.setattr(getattr(registry, module), function, stop)
    monkeypatch.setattr(registry.quality, "data_quality_bundle", lambda df: df)
    with pytest.raises(Seen) as seen:
        registry.QUERIES[name](spark, tables)
    files = seen.value.args[0]
    assert files and not [f for f in files if "lineitem" in f]


def test_written_builds_hold_source_columns(spark, tables):
    written = registry._written(spark, tables)
    files = spark.read.parquet(*written.inputFiles())
    assert {c[:2] for c in files.columns} == {"l_", "o_", "p_"} and len(files.columns) < len(written.columns)
    plain = registry._b(spark, tables)
    assert written.dtypes == plain.dtypes
    assert sorted(map(str, written.collect())) == sorted(map(str, plain.collect()))


def test_distinct_numbers_are_dealt_by_value_without_a_map_side_table(spark):
    schema = "a double, b long, c float, d string, e int, f boolean"
    rows = [(0.0, 2**53, 0.1, "x", None, True), (-0.0, 2**53 + 1, 0.1, "x", None, None), (float("nan"), -1, float("nan"), None, None, True),
            (float("nan"), None, None, "NaN", None, False), (None, 2**53, -0.0, "null", None, True)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = stats.constant_features(df)
    plan = plan_of(found)
    assert plan.count("REPARTITION_BY_COL") == 1 and "cast(a" not in plan
    as_text = df.select(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in df.columns]).first()
    assert {r["feature"]: r["unique_count"] for r in found.collect()} == as_text.asDict() == {"a": 4, "b": 4, "c": 4, "d": 4, "e": 1, "f": 3}
    assert stats.constant_features(df.where("b = 7")).count() == 0


def test_rows_are_not_shuffled_where_few_hashes_repeat(spark, tables):
    rows = spark.read.parquet(f"{tables}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    try:
        report = quality.duplicate_rows(rows)
        assert "SortMergeJoin" not in plan_of(report)
        assert report.first()["duplicate_count"] == 0
        assert quality.duplicate_rows(rows.unionByName(rows.limit(5))).first()["duplicate_count"] == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_request_files_are_compressed(spark, tables):
    path = registry._written_requests(spark, tables)
    assert glob.glob(f"{path}/*.json.gz") and not glob.glob(f"{path}/*.json")
    assert spark.read.json(path).count() == spark.read.parquet(f"{tables}/lineitem.parquet").count()


@pytest.mark.parametrize("buckets", [2, 3, 8, 9, 50])
def test_range_of_counts_the_bounds_below(spark, buckets):
    bounds = sorted((7 * i) % 40 / 2 for i in range(buckets - 1))
    rows = spark.createDataFrame([(v / 4, bounds) for v in range(-2, 90)], "value double, b array<double>")
    cut = ranks.range_of(F.col("value"), "b", buckets)
    assert all(r["at"] == sum(b < r["value"] for b in bounds) for r in rows.select("value", cut.alias("at")).collect())


def test_written_builds_join_orders_alike_at_every_size(spark, tables, tmp_path):
    columns = ["Sample_ID", "Thermal_Gradient", "Quality_Class"]
    plan = plan_of(source._joined(spark, tables, columns, "merge"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    hints = []
    real = source._joined
    with pytest.MonkeyPatch.context() as m:
        m.setattr(source, "_joined", lambda *a: hints.append(a[3:]) or real(*a))
        written = source.written_builds(spark, tables, str(tmp_path / "written"), columns)
    assert hints == [("merge",)]
    assert sorted(written.collect()) == sorted(source.builds(spark, tables, columns).collect())


def test_encoded_rows_are_written_in_files_of_bounded_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(ml, "FILE_ROWS", 7, raising=False)
    ready = ml.prepare(registry._training_rows(spark, tables), "inbuild")
    files = ready.rows.groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 240 and max(r["count"] for r in files) <= 7


def test_split_rows_are_not_shuffled_beside_the_ranges(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the ranges' size is not known before they are counted
    try:
        plan = plan_of(ml.stratified_split(registry._b(spark, tables, ["Sample_ID", "Laser_Power_W", "Microhardness_HV"]), label="Microhardness_HV"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_a_scenario_is_prepared_with_one_written_table_of_plain_columns(spark, tables, monkeypatch):
    written = []
    real = ml.shared_path
    monkeypatch.setattr(ml, "shared_path", lambda s, name: written.append(real(s, name)) or written[-1])
    ready = ml.prepare(registry._training_rows(spark, tables), "inbuild")
    assert len(written) == 1 and glob.glob(f"{written[0]}/*.zstd.parquet")
    kinds = {kind for _, kind in spark.read.parquet(written[0]).dtypes}
    assert kinds <= {"bigint", "double", "string", "boolean", "int"}
    assert ready.rows.count() == 240 and {"num_vec", "label", "is_test"} <= set(ready.rows.columns)
    assert ready.facts["n_rows_train"] + ready.facts["n_rows_test"] == ready.facts["n_rows_total"] == 240


def test_contract_csv_is_compressed_text_in_files_of_bounded_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(registry, "CSV_FILE_ROWS", 50, raising=False)
    scanned = registry.QUERIES["scan_csv_contract"](spark, tables)
    files = scanned.inputFiles()
    assert len(files) >= 5 and all(f.endswith(".csv.gz") for f in files)
    assert sorted(map(str, scanned.collect())) == sorted(map(str, registry._b(spark, tables).collect()))


@pytest.mark.parametrize("query", ["_score_batch", "_model_scored", "_evaluate_saved", "_stream_scoring"])
def test_a_model_scores_the_table_it_was_trained_on(spark, tables, monkeypatch, query):
    joined = []
    real = source._joined
    monkeypatch.setattr(source, "_joined", lambda *a: joined.append(a[2]) or real(*a))
    monkeypatch.setattr(registry, "_saved_lr", lambda *a: (None, {}))
    monkeypatch.setattr(registry.scoring, "score_with", lambda *a: lambda rows: rows)
    monkeypatch.setattr(registry.ml, "evaluate_saved", lambda model, metadata, rows: rows)
    assert getattr(registry, query)(spark, tables).count() > 200 and len(joined) == 1


def test_scored_records_and_stream_sources_are_compressed(spark, tables, tmp_path, monkeypatch):
    from fusionlens.streaming import monitoring
    batch = registry._requests(spark, tables)
    monitoring.score_epoch(batch, 0, f"{tmp_path}/valid", f"{tmp_path}/reject", lambda rows: rows)
    for name in ("valid", "reject"):
        assert glob.glob(f"{tmp_path}/{name}/epoch_id=0/*.zstd.parquet")
