"""Exact order statistics without putting a whole feature into one task.

``value_counts`` collapses a long (key..., value) table to distinct values
with counts (map-side combine, so a value holding a third of all rows is one
row). ``cumulative`` adds ``below`` = number of rows with a strictly smaller
value under the same key. A window over (key) ordered by value would put a
whole feature in one task, so values are first split into ``buckets`` ranges
by approximate quantiles of the distinct values; a small table of bucket
totals gives each bucket its offset, and the running sum is a window over
(key, bucket) only. Quantiles (linear interpolation) and average ranks with
ties are then plain joins and aggregates on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.session import shared_path


def value_counts(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., value, cnt) over non-null values."""
    return (
        long.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several branches read.

    The table is computed and written once as Parquet under the session's
    ``spark.checkpoint.dir`` (the shared folder on a cluster) and survives
    executor loss. Without it each branch re-runs the scan, join and
    shuffle below, because pushed-down filters make the branches differ and
    block exchange reuse. Streaming frames are returned unchanged.
    """
    if df.isStreaming:
        return df
    path = shared_path(df.sparkSession, "counts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# distinct values that one window task sorts
ROWS_PER_BUCKET = 500_000
# keys whose bounds may be broadcast; one short row per key
BROADCAST_KEYS = 10_000


def range_of(value: Column, bounds: str, buckets: int) -> Column:
    """How many of the ``buckets`` - 1 ascending ``bounds`` (an array column) are below ``value``, by halving steps.

    A row costs log2(buckets) comparisons: the number of ranges grows with the rows, so looking at
    every bound would make the whole quadratic.
    """
    steps = [1 << i for i in reversed(range((buckets - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, x: F.when(
        F.get(bounds, at + x - 1) < value, at + x).otherwise(at))


def cumulative(counts: DataFrame, keys: list[str], value: str = "value", buckets: int | None = None,
               accuracy: int = 10000, staged_input: bool = False) -> DataFrame:
    """Add ``below`` (rows with a smaller value, same key) and ``n`` (rows per key).

    The distinct values of a key are cut into ``buckets`` ranges (by default so
    many that a range has about ``ROWS_PER_BUCKET`` of them, from the staged
    counts). A small table of bucket totals gives each range its offset, and
    the running count is a window over (key, bucket). The counts feed several
    branches, so they are ``staged`` first unless the caller says
    ``staged_input``.
    """
    if not staged_input:
        counts = staged(counts)
    size = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d"), F.count(F.lit(1))).first()
    if buckets is None:
        buckets = max(1, -(-(size[0] or 0) // ROWS_PER_BUCKET))
    probs = [i / buckets for i in range(1, buckets)]
    if probs:
        bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, accuracy).alias("__bounds"))
        side = F.broadcast(bounds) if size[1] <= BROADCAST_KEYS else bounds
        c = counts.join(side, keys, "left").withColumn(
            "__bucket", range_of(F.col(value), "__bounds", buckets)).drop("__bounds")
    else:
        c = counts.withColumn("__bucket", F.lit(0))
    totals = c.groupBy(*keys, "__bucket").agg(F.sum("cnt").alias("__bt"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, "__bucket",
        F.coalesce(F.sum("__bt").over(before), F.lit(0)).alias("__off"),
        F.sum("__bt").over(whole).alias("n"),
    )
    c = c.join(offsets, keys + ["__bucket"])
    inner = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("below", F.col("__off") + F.coalesce(F.sum("cnt").over(inner), F.lit(0))).drop(
        "__off", "__bucket")


def quantiles(cum: DataFrame, keys: list[str], probs: list[float], value: str = "value") -> DataFrame:
    """Linear-interpolated quantiles per key from a ``cumulative`` table.

    Returns (keys..., p, q). For h = (n-1)p the two order statistics a, b at
    floor(h) and floor(h)+1 are found by a range match on [below, below+cnt);
    q = a + (b-a)t for t < 0.5 and b - (b-a)(1-t) otherwise (NumPy's form).
    """
    # every row already carries n, so each row tests itself against positions
    # floor(h) and floor(h)+1 of every requested p: one pass, no join back
    h = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    hits = F.array(*[F.struct(
        F.lit(float(p)).alias("p"),
        (hp - F.floor(hp)).alias("t"),
        ((F.col("below") <= F.floor(hp)) & (F.floor(hp) < F.col("below") + F.col("cnt"))).alias("is_a"),
        ((F.col("below") <= F.least(F.floor(hp) + 1, F.col("n") - 1))
         & (F.least(F.floor(hp) + 1, F.col("n") - 1) < F.col("below") + F.col("cnt"))).alias("is_b"),
    ) for p, hp in zip(probs, h)])
    picked = cum.select(*keys, value, F.explode(F.filter(hits, lambda x: x["is_a"] | x["is_b"])).alias("h"))
    ab = picked.groupBy(*keys, F.col("h.p").alias("p")).agg(
        F.max("h.t").alias("t"),
        F.max(F.when(F.col("h.is_a"), F.col(value))).alias("a"),
        F.max(F.when(F.col("h.is_b"), F.col(value))).alias("b"),
    )
    d = F.col("b") - F.col("a")
    q = F.when(F.col("t") >= 0.5, F.col("b") - d * (F.lit(1.0) - F.col("t"))).otherwise(F.col("a") + d * F.col("t"))
    return ab.select(*keys, "p", q.alias("q"))


def quantiles_wide(long: DataFrame, keys: list[str], probs: dict[str, float], value: str = "value",
                   buckets: int | None = None) -> DataFrame:
    """(keys..., <name> per prob) from a long table of raw values."""
    cum = cumulative(value_counts(long, keys, value), keys, value, buckets)
    q = quantiles(cum, keys, list(probs.values()), value)
    return q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name) for name, p in probs.items()
    ])


def quantiles_sql_parts(table: str, keys: list[str], value: str, probs: dict[str, float]) -> str:
    """SQL twin: order statistics by row_number, same interpolation (for the oracle)."""
    k = ", ".join(keys)
    on = " AND ".join(f"r.{c} = s.{c}" for c in keys)
    cols = []
    for name, p in probs.items():
        h = f"(s.n - 1) * {float(p)}"
        k0 = f"CAST(floor({h}) AS BIGINT)"
        t = f"({h} - floor({h}))"
        a = f"max(CASE WHEN r.rn - 1 = {k0} THEN r.{value} END)"
        b = f"max(CASE WHEN r.rn - 1 = least({k0} + 1, s.n - 1) THEN r.{value} END)"
        cols.append(
            f"CASE WHEN max({t}) >= 0.5 THEN {b} - ({b} - {a}) * (1.0 - max({t})) "
            f"ELSE {a} + ({b} - {a}) * max({t}) END AS {name}")
    return (
        f"SELECT {', '.join('s.' + c for c in keys)}, {', '.join(cols)} FROM "
        f"(SELECT {k}, {value}, row_number() OVER (PARTITION BY {k} ORDER BY {value}) AS rn FROM {table} "
        f"WHERE {value} IS NOT NULL AND NOT isnan({value})) r "
        f"JOIN (SELECT {k}, count(*) AS n FROM {table} WHERE {value} IS NOT NULL AND NOT isnan({value}) "
        f"GROUP BY {k}) s ON {on} GROUP BY {', '.join('s.' + c for c in keys)}"
    )


def average_ranks(cum: DataFrame) -> DataFrame:
    """Average rank with ties (1-based) for each distinct value: below + (cnt+1)/2."""
    return cum.withColumn("avg_rank", F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))
