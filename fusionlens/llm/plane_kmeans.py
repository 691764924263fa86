"""Centroid clustering on bit planes.

A vector of 64 components becomes integers ``floor(scale * x)``; bit i of all 64
is one unsigned 64-bit number, the vector's plane i (two's complement: the
highest plane counts negative). A centroid has planes too, and

    x . c = sum over planes i, j of  +-2**(i+j) * popcount(x plane i AND c plane j)

is exact, as is the squared distance x.x - 2 x.c + c.c. The number of planes
follows the data's range. Sums of a cluster are taken from counts of set bits,
plane by plane.

The planes are written once to the shared folder. Every round is one scan of
them that ends in a row of sums a cluster and task; the driver holds centroids
only (k x 64 integers). No vector is shuffled but the k first centroids.

Edge cases: vectors that are NULL, do not have 64 components, or hold a NULL,
NaN or infinite one take no part and are not returned. Rows with a NULL id are
assigned but never start a centroid; repeated rows count each; fewer vectors than k
give fewer centroids; ties go to the smaller number; an empty centroid stays.
An empty table gives an empty result. Components of 2**27 / scale or more are an
error, as distances would leave 64 bits. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm.sizing import staged

DIM = 64
MOST = 1 << 27
_STEP = 8192  # rows at once


def to_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits) 64-bit planes of (rows, 64) integers."""
    planes = [np.packbits((x >> i & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for i in range(bits)]
    return np.concatenate(planes, axis=1)


def place_values(bits: int) -> np.ndarray:
    value = np.int64(1) << np.arange(bits, dtype=np.int64)
    value[-1] = -value[-1]
    return value


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of every row with the row of ``other`` (one row: with that one)."""
    value = place_values(planes.shape[1])
    total = np.zeros(len(planes), dtype=np.int64)
    for j, v in enumerate(value):
        total += v * (np.bitwise_count(planes & other[:, j:j + 1]).astype(np.int64) @ value)
    return total


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; ties: the smaller number."""
    square = dots(planes, planes)
    best, distance = np.zeros(len(planes), np.int32), None
    for k in range(len(centroids)):
        c = centroids[k:k + 1]
        d = square - 2 * dots(planes, c) + dots(c, c)[0]
        if distance is None:
            distance = d
        else:
            closer = d < distance
            best[closer], distance = k, np.where(closer, d, distance)
    return best, distance


def component_sums(planes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(planes.view(np.uint8).reshape(len(planes), planes.shape[1], 8), axis=2, bitorder="little")
    return place_values(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and planes, some thousand rows at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, _STEP):
            part = batch.slice(i, _STEP)
            column = part.column(1).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            first = np.frombuffer(offsets, np.int64)[column.offset]
            yield part.column(0), np.frombuffer(data, np.uint64, part.num_rows * bits, first).reshape(-1, bits)


def _pack(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int, int]:
    """Ids and planes of the vectors that take part, the number of planes, the number of vectors."""
    whole = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") == DIM)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = F.transform("v", lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit(f"a component is {MOST} / {scale} or more"))))
    ints = whole.select("vec_id", scaled.alias("x"))
    low, high, n = ints.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.count(F.lit(1))).first()
    if not n:
        low = high = 0
    bits = max(int(high).bit_length() if high > 0 else 0, int(-low - 1).bit_length() if low < 0 else 0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _STEP):
                part = batch.slice(i, _STEP)
                x = part.column(1).flatten().to_numpy().reshape(-1, DIM)
                data = to_planes(x, bits).tobytes()
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * (8 * bits)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), packed], ["vec_id", "planes"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    return staged(ints.mapInArrow(run, f"vec_id {kind}, planes binary"), "planes"), bits, n


def _round(table: DataFrame, centroids: np.ndarray, bits: int) -> dict[int, tuple[int, int, list[int]]]:
    """Size, summed distance and component sums of every cluster that has vectors: k rows."""
    planes = to_planes(centroids, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(planes)
        count, spread, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, DIM), np.int64)
        for _, x in _blocks(batches, bits):
            best, distance = nearest(x, planes)
            count += np.bincount(best, minlength=k)
            np.add.at(spread, best, distance)
            for c in np.unique(best):
                sums[c] += component_sums(x[best == c])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(spread[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "spread", "sums"])

    parts = table.mapInArrow(run, "cluster int, n long, spread long, sums array<long>")
    found = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("spread").cast("decimal(38,0)")).alias("spread"),
        *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIM)]).collect()
    return {r["cluster"]: (r["n"], int(r["spread"]), [int(r[f"s{i}"]) for i in range(DIM)]) for r in found}


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` of each vector."""
    table, bits, n = _pack(vectors, id_col, vector_col, scale)
    kind = table.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.where("vec_id IS NOT NULL").orderBy(order, "planes").limit(k).collect()  # k rows
    if not n or not first:
        return table.sparkSession.createDataFrame([], fields)
    start = np.stack([np.frombuffer(r["planes"], np.uint64) for r in first])
    centroids = np.stack([component_sums(row[None, :]) for row in start])
    for _ in range(rounds):
        for c, (size, _, sums) in _round(table, centroids, bits).items():
            centroids[c] = [s // size for s in sums]
    spread = {c: s for c, (_, s, _) in _round(table, centroids, bits).items()}
    planes = to_planes(centroids, bits)
    inertia, whole = np.array([spread.get(c, 0) for c in range(len(planes))], dtype=np.int64), sum(spread.values())
    shown = pa.array(centroids.tolist(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, x in _blocks(batches, bits):
            best, distance = nearest(x, planes)
            yield pa.RecordBatch.from_arrays(
                [name, pa.array(best), pa.array(distance), pa.array(inertia[best]),
                 pa.array(np.full(len(best), whole, np.int64)), shown.take(pa.array(best))],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return table.mapInArrow(run, fields)


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> str:
    """The contract's rows in DuckDB SQL: one pair of steps a round, doubles that hold exact integers."""
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT rid, c, list_inner_product(x, x) - 2 * list_inner_product(x, m) + list_inner_product(m, m) AS d FROM v, c{i})
  GROUP BY rid)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
    SELECT c, list(floor(s / size) ORDER BY p) AS m
    FROM (SELECT c, p, sum(x[p]) AS s, count(*) AS size
          FROM (SELECT c, x, unnest(range(1, {DIM + 1})) AS p FROM a{i} JOIN v USING (rid)) GROUP BY c, p)
    GROUP BY c) n USING (c))"""

    steps = ",\n".join(f"{assigned(i)},\n{moved(i)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS x
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m
  FROM (SELECT x, sha256('{seed}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
{steps},
{assigned(rounds)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(m, lambda e: e::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""
