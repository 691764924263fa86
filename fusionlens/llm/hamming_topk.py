"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Vectors become 64-bit sign codes. A code is cut into segments of about log2(n)
bits; a table holds every distinct code once for each segment's value. Round r
probes, for each query code that is not settled, all values that differ from
its segments in exactly r bits. Two codes that differ in fewer than
``segments * (r + 1)`` bits differ in at most r bits on some segment, so after
round r every code at a distance up to ``segments * (r + 1) - 1`` has been
verified; a query whose k-th verified distance is within that is settled, and
the others go on with a larger radius (in the end all values are probed). A
pair is kept only in the round and segment that reach it first, so it comes
up once in all rounds.

The table is cut into shards by the first bits of a segment's value, and a shard
of more than ``SHARD_ROWS`` codes (a hot value) is dealt to several. A query is sent once to each
shard that its probes can reach, those whose prefix differs in at most r bits, and the probes
of the remaining bits are looked up inside the shard's task, which keeps a query's best k + 1
codes. Queries are dealt to blocks of ``QUERY_ROWS``, so a task's memory has a bound.
Where a radius has more probes than a shard has codes, the shard's values are compared instead.

Copies collapse before the search: the table holds distinct codes with their
k + 1 smallest ids (more can not be among k results, as ties go to smaller
ids), and queries with equal codes are searched for once.

Edge cases: rows with a NULL id or a NULL vector take no part; a NULL or NaN
component is a zero bit, as is one that a shorter vector lacks; vectors of more
than 64 components are an error. A repeated (id, code) counts once; a row is
never its own neighbour. Fewer than k other rows give fewer results. An empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.llm.sizing import staged

BITS = 64
PROBE_ROWS = 1 << 17
PREFIX_ROWS = 1 << 13  # codes in a shard, as long as MOST_PREFIX_BITS number enough shards
MOST_PREFIX_BITS = 12
SHARD_ROWS = 1 << 17  # codes in a shard's task
QUERY_ROWS = 1 << 18  # queries in a shard's task, about


def sign_code(vector: Column) -> Column:
    """Bit i is set if component i is above zero."""
    bits = F.transform(vector, lambda x, i: F.when(
        (x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a vector has more than {BITS} components"))).otherwise(code)


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of segments of about log2(n) bits."""
    n = max(2, round(BITS / max(8, min(32, math.log2(max(2, n_codes))))))
    return [(i * BITS // n, (i + 1) * BITS // n - i * BITS // n) for i in range(n)]


def _flips(width: int, r: int) -> np.ndarray:
    """All numbers of ``width`` bits with r of them set."""
    rows = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(width), r)), np.int64)
    return (np.int64(1) << rows.reshape(-1, r)).sum(axis=1) if r else np.zeros(1, np.int64)


def _prefix_bits(n_codes: int, width: int) -> int:
    """Bits of a segment's value that number its shards."""
    return min(width, MOST_PREFIX_BITS, max(0, math.ceil(math.log2(max(1, n_codes / PREFIX_ROWS)))))


def _segment_value(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def _segment_table(codes: DataFrame, cut: list[tuple[int, int]], prefix: list[int]) -> tuple[DataFrame, DataFrame]:
    """(segment, shard, salt, code, ids) and the number of salts of every shard that holds codes."""
    places = F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(
        _segment_value(F.col("code"), low, width), width - prefix[i]).alias("shard")) for i, (low, width) in enumerate(cut)])
    rows = codes.select(F.explode(places).alias("s"), "code", "ids").select("s.segment", "s.shard", "code", "ids")
    salts = staged(rows.groupBy("segment", "shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).alias("salts")), "salts")
    # at most 8 segments of 2^MOST_PREFIX_BITS shards
    dealt = rows.join(F.broadcast(salts), ["segment", "shard"]).select(
        "segment", "shard", F.pmod(F.xxhash64("code"), F.col("salts")).alias("salt"), "code", "ids")
    return staged(dealt, "segment-table"), salts


def _sent(queries: DataFrame, salts: DataFrame, cut: list[tuple[int, int]], prefix: list[int], r: int) -> DataFrame:
    """Each query of round r once for each shard it can reach, with the bits ``left`` to differ inside."""
    reach = []
    for i, (low, width) in enumerate(cut):
        inner = width - prefix[i]
        own = F.shiftrightunsigned(_segment_value(F.col("query"), low, width), inner)
        flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << prefix[i]) - 1).cast("long")),
                         lambda x: (F.bit_count(x) <= r) & (F.lit(r) - F.bit_count(x) <= inner))
        reach.append(F.transform(flips, lambda x: F.struct(
            F.lit(i).alias("segment"), own.bitwiseXOR(x).alias("shard"), (F.lit(r) - F.bit_count(x)).alias("left"))))
    sent = queries.select("query", "bound", F.explode(F.concat(*reach)).alias("s")).select("query", "bound", "s.*")
    salted = sent.join(F.broadcast(salts), ["segment", "shard"])  # the bound of _segment_table
    return salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")


def _pairs(value: np.ndarray, own: np.ndarray, inner: int, differing: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of own, position in value) of all pairs that differ in just so many bits; ``value`` is sorted."""
    if math.comb(inner, differing) > len(value):
        step = max(1, PROBE_ROWS // len(value))
        for i in range(0, len(own), step):
            at, position = np.nonzero(np.bitwise_count(own[i:i + step, None] ^ value[None, :]) == differing)
            yield at + i, position
        return
    flips = _flips(inner, differing)
    step = max(1, PROBE_ROWS // len(flips))
    for i in range(0, len(own), step):
        for f in np.array_split(flips, -(-len(flips) // PROBE_ROWS)):
            probe = (own[i:i + step, None] ^ f[None, :]).ravel()
            first = np.searchsorted(value, probe, "left")
            size = np.searchsorted(value, probe, "right") - first
            hit = np.flatnonzero(size)
            # pieces of about PROBE_ROWS pairs; one probe has at most a shard's rows
            piece = np.cumsum(size[hit]) // PROBE_ROWS
            for part in np.split(hit, np.flatnonzero(np.diff(piece)) + 1):
                n = size[part]
                yield (np.repeat(part // len(f) + i, n),
                       np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum()))


def _best(found: list[tuple], rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, position, distance) pieces the ``most`` nearest of each query, ties by rank."""
    query, position, distance = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((rank[position], distance, query))
    query, position, distance = query[order], position[order], distance[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, "left")
    keep = place < most
    return query[keep], position[keep], distance[keep]


def _search(cut: list[tuple[int, int]], prefix: list[int], r: int, most: int):
    """A shard's task: the codes that its queries meet there first, the ``most`` nearest of each query."""
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query", "distance", "code", "ids"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()),
                             pa.array([], held.schema.field("ids").type)], names=names)
        segment = asked.column("segment")[0].as_py()
        low, inner = cut[segment][0], cut[segment][1] - prefix[segment]
        inside = lambda c: (c.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << inner) - 1)
        held = held.append_column("first", pc.list_element(held.column("ids"), 0)).sort_by(
            [("first", "ascending"), ("code", "ascending")])
        code = held.column("code").to_numpy()
        rank = np.argsort(inside(code), kind="stable")  # rows are in the order of ties, so a row's number is its rank
        value, code = inside(code)[rank], code[rank]
        query, bound, left = (asked.column(c).to_numpy() for c in ("query", "bound", "left"))
        found, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))], 0
        for differing in np.unique(left):
            some = np.flatnonzero(left == differing)
            for at, position in _pairs(value, inside(query[some]), inner, int(differing)):
                at = some[at]
                differ = (query[at] ^ code[position]).view(np.uint64)
                distance = np.bitwise_count(differ).astype(np.int32)
                weight = np.stack([np.bitwise_count((differ >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in cut])
                keep = (distance <= bound[at]) & (weight.argmin(axis=0) == segment) & (weight.min(axis=0) == r)
                found.append((at[keep], position[keep], distance[keep]))
                size += int(keep.sum())
                if size > 4 * PROBE_ROWS:
                    found = [_best(found, rank, most)]
                    size = 0
        at, position, distance = _best(found, rank, most)
        return pa.table([pa.array(query[at]), pa.array(distance), pa.array(code[position]),
                         held.column("ids").take(pa.array(rank[position]))], names=names)

    return run


def _verified(active: DataFrame, n_active: int, table: DataFrame, salts: DataFrame, cut: list[tuple[int, int]],
              prefix: list[int], r: int, most: int) -> DataFrame:
    """``query``, ``distance``, ``code``, ``ids`` of round r."""
    blocks = max(1, -(-n_active // QUERY_ROWS))
    key = ["segment", "shard", "salt", "block"]
    asked = _sent(active, salts, cut, prefix, r).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    held = table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    ids = table.schema["ids"].dataType.simpleString()
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        _search(cut, prefix, r, most), f"query long, distance int, code long, ids {ids}")


def top_k(vectors: DataFrame, k: int = 10, queries: Column | None = None, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``neighbour_id``, ``distance``: the k nearest other rows of each query row.

    ``queries`` is a condition on the columns ``id`` and ``code``; by default all rows are queries.
    """
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL").select("id", sign_code(F.col("v")).alias("code"))
    rows = staged(rows.distinct(), "codes")
    most = k + 1  # a query row may find itself
    ids = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= most)
    codes = staged(ids.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-codes")
    n_codes = codes.count()
    cut = segments(n_codes)
    prefix = [_prefix_bits(n_codes, width) for _, width in cut]
    table, salts = _segment_table(codes, cut, prefix)
    asked = rows if queries is None else rows.where(queries)
    active = staged(asked.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    best, settled, n_active = None, [], active.count()
    for r in range(max(width for _, width in cut) + 1):
        covered = min(BITS, len(cut) * (r + 1) - 1)
        found = _verified(active, n_active, table, salts, cut, prefix, r, most).select(
            "query", "distance", F.explode("ids").alias("id"), "code")
        if best is not None:
            found = found.unionByName(best)
        place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id", "code"))
        found = staged(found.withColumn("n", place).where(F.col("n") <= most).drop("n"), "verified")
        full = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where(F.col("n") >= most)
        state = staged(active.select("query").join(full, "query", "left").select(
            "query", F.coalesce("kth", F.lit(BITS)).alias("bound"),
            (F.col("kth").isNotNull() & (F.col("kth") <= covered)).alias("done")), "search-state")
        settled.append(found.join(state.where("done").select("query"), "query", "left_semi"))
        active = state.where("NOT done").select("query", "bound")
        best = found.join(active.select("query"), "query", "left_semi")
        n_active = active.count()
        if not n_active:
            break
    settled.append(best)
    results = settled[0]
    for more in settled[1:]:
        results = results.unionByName(more)
    joined = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(results, "query").where(
        ~((F.col("id") == F.col("query_id")) & (F.col("code") == F.col("query"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "id", "code"))
    return joined.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("neighbour_id"), "distance")


def oracle(k: int = 10, every: int = 20) -> str:
    """The same neighbours in DuckDB SQL, for queries whose id is divisible by ``every``."""
    return f"""
WITH code AS (
  SELECT DISTINCT vec_id AS id, array_to_string(list_transform(range(1, {BITS + 1}), lambda i:
    CASE WHEN embedding[i] > 0 AND NOT isnan(embedding[i]) THEN '1' ELSE '0' END), '')::BIT AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pair AS (
  SELECT q.id AS query_id, q.c AS qc, r.id AS neighbour_id, r.c AS rc, bit_count(xor(q.c, r.c))::INTEGER AS distance
  FROM code q JOIN code r ON q.id % {every} = 0 AND NOT (q.id = r.id AND q.c = r.c))
SELECT query_id, rank::INTEGER AS rank, neighbour_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qc ORDER BY distance, neighbour_id) AS rank FROM pair)
WHERE rank <= {k}"""
