"""Helpers of the tests beside this file."""

import math

import duckdb

SF = "/root/testdata/sf0.001"


def _cell(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def as_rows(rows):
    return sorted((tuple(_cell(v) for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def duck(name, docs, columns):
    from fusionlens.llm import queries

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    return con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
