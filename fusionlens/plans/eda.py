"""The EDA run as one Spark plan: load once, level-1/2/3 reports, gate, sinks, audit.

The input is written once to the shared folder (``spark.checkpoint.dir``):
the write cuts the lineage, survives executor loss, and every report then scans
only its own columns from parquet. Reports are lazy DataFrames; the gate is
one small action; each report is written once to ``output_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fusionlens.operators import challenge, quality, stats
from fusionlens.session import shared_path
from fusionlens.sources import files
from fusionlens.sources.builds import builds


def read_input(spark: SparkSession, source: DataFrame | str) -> DataFrame:
    """The table to report on: a DataFrame, a CSV with a header, or the folder of the generated tables."""
    if isinstance(source, DataFrame):
        return source
    if source.rstrip("/").endswith(".csv"):
        return files.scan_csv_contract(spark, source).drop("_corrupt_record")
    return builds(spark, source)


def run_eda(spark: SparkSession, source: DataFrame | str, output_dir: str, fail_on_warning: bool = False,
            include_model: bool = True) -> dict:
    """Returns {"gate": Row, "exit_code": int, "reports": {name: path}}; stops after level 1 if columns are missing."""
    path = shared_path(spark, "builds")
    read_input(spark, source).write.parquet(path)
    table = spark.read.parquet(path)
    named = source if isinstance(source, str) else "DataFrame"
    audit = f"{output_dir.rstrip('/')}/_audit"
    level1 = {
        "schema": quality.schema_report(table),
        "missing_values": quality.missing_values(table),
        "duplicates": quality.duplicate_rows(table),
        "target": quality.target_report(table),
        "physical_ranges": quality.physical_ranges(table),
    }
    paths = files.sink_reports(level1, output_dir)
    gate = quality.quality_gate(quality.data_quality_bundle(table)).first()
    if gate["status"] != "FAIL":
        level2 = stats.statistical_reports(table)
        level3 = challenge.challenge_reports(table, include_model)
        gate = quality.quality_gate(quality.data_quality_bundle(table).unionByName(stats.statistical_bundle(table))).first()
        paths |= files.sink_reports(level2, output_dir)
        paths |= files.sink_reports(level3, f"{output_dir.rstrip('/')}/challenge")
    files.run_audit(spark, audit, named, table.count(), len(table.columns),
                    gate["status"], gate["fail_count"], gate["warn_count"], gate["message"])
    exit_code = 1 if gate["status"] == "FAIL" or (fail_on_warning and gate["status"] == "WARN") else 0
    return {"gate": gate, "exit_code": exit_code, "reports": paths}
