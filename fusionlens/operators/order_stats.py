"""Exact quantiles by digit counts: no sort, no shuffle of values.

A double becomes a 64-bit integer of the same order. One scan counts, map-side,
how many values of each column begin with which 20 bits; the counts of all tasks
are summed (at most 2**20 short rows a column, some hundreds for each power of two that
its values span), and each wanted order statistic falls into one of them. The next scan
counts the next 20 bits of the values that share such a prefix, and so on, until the
values under every prefix are one and the same: one or two scans for measured
data (40 bits hold eight significant digits), four at most. A value that a
third of all rows hold is one count. The driver holds one prefix for each
column, class and order statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 18
DIGITS = (20, 20, 12, 12)
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles (-0.0 is 0.0)."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _LOW, bits)


def from_bits(bits: int) -> float:
    raw = np.int64(bits)
    return float((raw ^ _LOW if raw < 0 else raw).view(np.float64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _counts(rows: DataFrame, columns: list[str], shift: int, digit: int, wanted: dict[tuple, np.ndarray] | None) -> DataFrame:
    """(by, column, head, n, lo, hi): values by their leading bits, of those that begin with a wanted prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            labels = table.column("__by").combine_chunks().dictionary_encode()
            names, code = labels.dictionary.to_pylist(), labels.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for k, by in [(-1, None), *enumerate(names)]:
                mine = code == k if len(names) or k < 0 else np.zeros(0, bool)
                if not mine.any():
                    continue
                for c, name in enumerate(columns):
                    prefixes = None if wanted is None else wanted.get((by, c))
                    if wanted is not None and prefixes is None:
                        continue
                    x = table.column(name).to_numpy()
                    x = x[mine & ~np.isnan(x)] if not mine.all() else x[~np.isnan(x)]
                    value, n = np.unique(ordered_bits(x), return_counts=True)
                    if prefixes is not None:
                        some = np.isin(value >> (shift + digit), prefixes)
                        value, n = value[some], n[some]
                    if not len(value):
                        continue
                    head = value >> shift
                    first = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
                    size = len(first)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([by] * size, pa.string()), pa.array(np.full(size, c, np.int32)), pa.array(head[first]),
                         pa.array(np.add.reduceat(n, first).astype(np.int64)), pa.array(value[first]),
                         pa.array(value[np.concatenate((first[1:], [len(value)])) - 1])],
                        ["by", "column", "head", "n", "lo", "hi"])

    parts = rows.mapInArrow(run, "by string, column int, head long, n long, lo long, hi long")
    return parts.groupBy("by", "column", "head").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def class_value_counts(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(feature, value, ``by``, cj): how many rows of a class hold a value; counted in each task, then summed."""
    rows = df.where(F.col(by).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(by).cast("string").alias("__by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            labels = table.column("__by").combine_chunks().dictionary_encode()
            code = labels.indices.to_numpy()
            for c, feature in enumerate(columns):
                x = table.column(f"c{c}").to_numpy()
                for k, label in enumerate(labels.dictionary.to_pylist()):
                    mine = x[code == k]
                    value, n = np.unique(mine[~np.isnan(mine)] + 0.0, return_counts=True)
                    for i in range(0, len(value), 1 << 15):
                        v, m = value[i:i + (1 << 15)], n[i:i + (1 << 15)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([feature] * len(v)), pa.array(v), pa.array([label] * len(v)), pa.array(m.astype(np.int64))],
                            ["feature", "value", by, "cj"])

    return rows.mapInArrow(run, f"feature string, value double, `{by}` string, cj long").groupBy("feature", "value", by).agg(
        F.sum("cj").alias("cj"))


def binned_class_counts(df: DataFrame, bounds: dict[str, tuple[float, float]], texts: list[str], by: str, bins: int) -> DataFrame:
    """(feature, cell, ``by``, n): rows of a class by equal-width bin (edges lo + i * width, left-closed) or by text.

    ``bounds`` has the columns of numbers (a missing value is the cell "null"); counted in each task, then summed.
    """
    numbers = list(bounds)
    rows = df.where(F.col(by).isNotNull()).select(
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(numbers)],
        *[F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(texts)], F.col(by).cast("string").alias("__by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            labels = table.column("__by").combine_chunks().dictionary_encode()
            code, names = labels.indices.to_numpy(), labels.dictionary.to_pylist()
            k = len(names)
            for column, feature in [*((f"c{i}", c) for i, c in enumerate(numbers)), *((f"s{i}", c) for i, c in enumerate(texts))]:
                if feature in bounds:
                    x, (lo, hi) = table.column(column).to_numpy(), bounds[feature]
                    cell = np.zeros(len(x), dtype=np.int64)  # a column without values
                    if lo is not None:
                        edges = [lo + i * ((hi - lo) / bins) for i in range(1, bins)]
                        cell = np.where(np.isnan(x), 0, 1 + (np.searchsorted(edges, x, side="right") if hi != lo else 0))
                    cells = ["null", *[str(i) for i in range(1, bins + 1)]]
                else:
                    text = table.column(column).combine_chunks().dictionary_encode()
                    cell, cells = text.indices.to_numpy().astype(np.int64), text.dictionary.to_pylist()
                joint = np.bincount(cell * k + code, minlength=len(cells) * k)
                some = np.flatnonzero(joint)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([feature] * len(some)), pa.array([cells[i // k] for i in some]), pa.array([names[i % k] for i in some]),
                     pa.array(joint[some].astype(np.int64))], ["feature", "cell", by, "n"])

    return rows.mapInArrow(run, f"feature string, cell string, `{by}` string, n long").groupBy("feature", "cell", by).agg(
        F.sum("n").alias("nxy"))


def distinct_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, unique_count) of columns of numbers, by their 64 bits: NULL is a value, every NaN is one, -0.0 is not 0.0.

    Each task collapses its batches; what is left is dealt by value before it is counted, because a
    map-side table of nearly all values of a task would spill.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            for c in range(len(columns)):
                column = table.column(c).combine_chunks()
                x = column.drop_null().to_numpy(zero_copy_only=False)
                if x.dtype.kind == "f":
                    x = x.astype(np.float64)
                    x = np.where(np.isnan(x), np.nan, x).view(np.int64)
                value = pa.array(np.unique(x.astype(np.int64)))
                if column.null_count:
                    value = pa.concat_arrays([value, pa.nulls(1, pa.int64())])
                for i in range(0, len(value), 1 << 16):
                    some = value[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), c, np.int32)), some], ["column", "value"])

    values = df.select(*columns).mapInArrow(run, "column int, value long").repartition("column", "value").distinct()
    counted = values.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return counted.select(F.get(F.array(*[F.lit(c) for c in columns]), "column").alias("feature"), "unique_count")


def _ranks(n: int, probs: list[float]) -> list[int]:
    """The order statistics (0-based) that linear interpolation needs."""
    return sorted({r for p in probs for low in [int(np.floor((n - 1) * p))] for r in (low, min(low + 1, n - 1))})


def interpolate(values: dict[int, float], n: int, p: float) -> float:
    """NumPy's form: a + (b - a) t below t = 0.5, b - (b - a)(1 - t) from there on."""
    h = (n - 1) * p
    low = int(np.floor(h))
    t, a, b = h - low, values[low], values[min(low + 1, n - 1)]
    return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t


def exact_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float], by: str | None = None) -> list[dict]:
    """One dict for each column (and value of ``by``) that has values: feature, by, n, and each named quantile.

    NULL and NaN values are left out, as are rows whose ``by`` is NULL. Runs one to four small jobs.
    """
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)],
                     (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("__by"))
    rows = rows.where("__by IS NOT NULL") if by else rows
    names = [f"c{i}" for i in range(len(columns))]
    wanted: dict[tuple, list[tuple[int, int, int]]] | None = None  # (by, column): (rank, prefix, rows below the prefix)
    total: dict[tuple, int] = {}
    found: dict[tuple, dict[int, float]] = {}
    shift = 64
    for digit in DIGITS:
        shift -= digit
        targets = wanted

        def pick(group: pa.Table) -> pa.Table:
            group = group.sort_by("head")
            head, n, lo, hi = (group.column(c).to_numpy() for c in ("head", "n", "lo", "hi"))
            key = group.column("by")[0].as_py(), group.column("column")[0].as_py()
            whole = int(n.sum())
            asked = [(r, None, 0) for r in _ranks(whole, list(probs.values()))] if targets is None else targets[key]
            out = []
            for rank, prefix, below in asked:
                mine = slice(None) if prefix is None else np.flatnonzero(head >> digit == prefix)
                upto = below + np.cumsum(n[mine])
                i = int(np.searchsorted(upto, rank, side="right"))
                before = below + int(n[mine][:i].sum())
                out.append((*key, whole, rank, int(head[mine][i]), before, int(lo[mine][i]), int(hi[mine][i])))
            fields = ["by", "column", "whole", "rank", "head", "below", "lo", "hi"]
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 6]
            return pa.Table.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], fields)

        prefixes = None if wanted is None else {k: np.unique([p for _, p, _ in v]) for k, v in wanted.items()}
        picked = _counts(rows, names, shift, digit, prefixes).groupBy("by", "column").applyInArrow(
            pick, "by string, column int, whole long, rank long, head long, below long, lo long, hi long").collect()
        following: dict[tuple, list] = {}
        for r in picked:  # a few rows for each column and class
            key = r["by"], r["column"]
            if wanted is None:
                total[key] = r["whole"]
            if r["lo"] == r["hi"]:
                found.setdefault(key, {})[r["rank"]] = from_bits(r["lo"])
            else:
                following.setdefault(key, []).append((r["rank"], r["head"], r["below"]))
        wanted = following
        if not wanted:
            break
    return [{"feature": columns[c], "by": b, "n": n, **{name: interpolate(found[b, c], n, p) for name, p in probs.items()}}
            for (b, c), n in sorted(total.items(), key=lambda x: (str(x[0][0]), x[0][1]))]


def quantile_table(df: DataFrame, columns: list[str], probs: dict[str, float], by: str | None = None) -> DataFrame:
    """``exact_quantiles`` as a table: feature, (by), n, the quantiles."""
    rows = exact_quantiles(df, columns, probs, by)
    keys = ["feature", *([by] if by else [])]
    schema = ", ".join([f"`{k}` string" for k in keys] + ["n long"] + [f"`{p}` double" for p in probs])
    return df.sparkSession.createDataFrame(
        [(r["feature"], *([r["by"]] if by else []), r["n"], *[r[p] for p in probs]) for r in rows], schema)
