"""Mutual information of a number with a class, from nearest neighbours.

For each row, the radius is the distance to its third neighbour of the same
class (fewer where the class has fewer rows); k is the number of other rows of
its class within the radius, m that of all other rows. Over the N rows of
classes with at least two rows, MI = psi(N) + mean(psi(k) - psi(class size) - psi(m)),
0 at least. Without ties k is 3 and this is the usual estimator
for a continuous feature; with ties the rows at the same distance count in both
k and m, so no random noise is needed and a rerun gives the same figures.

Work is done on distinct (feature, class, value) with their counts: a value held by a
third of all rows is one row for each class. Values are cut into ranges. The
three values before and after a range, of the same class, come along as read-only
rows, and rows within the radius are counted by running sums of a
range plus its offset, so no task holds a whole feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.operators import ranks

NEIGHBOURS = 3
_SERIES_FROM = 16
#: psi(1), psi(2), ... below the first integer that the series serves
_PSI = [-0.5772156649015329 + math.fsum(1.0 / i for i in range(1, n)) for n in range(1, _SERIES_FROM)]


def digamma(n: Column) -> Column:
    """psi of a positive integer: exact sums for small ones, the asymptotic series (error below 1e-15) from there."""
    x = n.cast("double")
    i2 = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    small = F.get(F.array(*[F.lit(p) for p in _PSI]), (F.least(n, F.lit(_SERIES_FROM - 1)) - 1).cast("int"))
    return F.when(n < _SERIES_FROM, small).otherwise(series)


def digamma_sql(n: str) -> str:
    x, i2 = f"CAST({n} AS DOUBLE)", f"(1.0 / (CAST({n} AS DOUBLE) * CAST({n} AS DOUBLE)))"
    table = ", ".join(f"CAST({p!r} AS DOUBLE)" for p in _PSI)
    return (f"CASE WHEN {n} < {_SERIES_FROM} THEN list_extract([{table}], CAST({n} AS BIGINT)) ELSE ln({x}) - 0.5 / {x} - {i2} * "
            f"(1.0 / 12 - {i2} * (1.0 / 120 - {i2} * (1.0 / 252 - {i2} * (1.0 / 240 - {i2} / 132)))) END")


def _with_halo(own: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``own`` plus, for every (keys, range), the k values before its first and after its last one (``__halo``)."""
    part = Window.partitionBy(*keys, "__bucket")
    edges = own.withColumn("__first", F.row_number().over(part.orderBy("value"))).withColumn(
        "__last", F.row_number().over(part.orderBy(F.desc("value")))).where((F.col("__first") <= k) | (F.col("__last") <= k))
    # at most 2k rows a range: the order over a whole key is one of short rows
    line = Window.partitionBy(*keys).orderBy("value")
    targets = []
    for i in range(1, k + 1):
        for move, end in ((F.lead, "__first"), (F.lag, "__last")):
            there = move("__bucket", i).over(line)
            targets.append(F.when((move(end, i).over(line) == 1) & (there != F.col("__bucket")), there))
    halo = edges.withColumn("__to", F.array_distinct(F.array_compact(F.array(*targets)))).select(
        *[c for c in own.columns if c != "__bucket"], F.explode("__to").alias("__bucket"))
    return own.withColumn("__halo", F.lit(False)).unionByName(halo.withColumn("__halo", F.lit(True)))


def neighbour_mi(counts: DataFrame, label: str, k: int = NEIGHBOURS, buckets: int | None = None) -> DataFrame:
    """(feature, mi) from (feature, value, ``label``, cj): how many rows of a class hold a value.

    ``counts`` is written once and feeds several branches. Infinite values and classes with a
    single row of the feature are left out, and so is a feature that has nothing else. ``buckets`` is
    the number of ranges (by default so many that one has about ``ranks.ROWS_PER_BUCKET`` values).
    """
    keys = ["feature", label]
    counts = ranks.staged(counts.where(F.abs("value") < float("inf")).withColumn("cj", F.col("cj").cast("long")))
    size = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d"), F.count(F.lit(1))).first()
    if buckets is None:
        buckets = max(1, -(-(size[0] or 0) // ranks.ROWS_PER_BUCKET))
    members = counts.groupBy(*keys).agg(F.sum("cj").alias("ny")).where("ny > 1")
    rows = counts.join(members, keys)
    if buckets > 1:
        bounds = counts.groupBy("feature").agg(
            F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10000).alias("__bounds"))
        bounds = F.broadcast(bounds) if size[1] <= ranks.BROADCAST_KEYS else bounds

    def ranged(df: DataFrame) -> DataFrame:
        if buckets == 1:
            return df.withColumn("__bucket", F.lit(0))
        return df.join(bounds, "feature").withColumn("__bucket", ranks.range_of(F.col("value"), "__bounds", buckets)).drop("__bounds")

    own = ranged(rows)
    line = Window.partitionBy(*keys, "__bucket").orderBy("value")
    near = [F.struct(F.abs(move("value", i).over(line) - F.col("value")).alias("d"), move("cj", i).over(line).alias("c"),
                     move("value", i).over(line).alias("v"))
            for i in range(1, k + 1) for move in (F.lag, F.lead)]
    near_rows = _with_halo(own, keys, k).withColumn("__near", F.array_sort(F.filter(F.array(*near), lambda x: x["d"].isNotNull()))) \
        .where(~F.col("__halo"))
    wanted = F.least(F.lit(k), F.col("ny") - 1)
    # nearest first: take distances until ``wanted`` rows are in, then all at that distance
    reach = F.aggregate(
        "__near", F.struct((F.col("cj") - 1).alias("k"), F.lit(0.0).alias("r")),
        lambda acc, x: F.when((acc["k"] < wanted) | (x["d"] == acc["r"]), F.struct((acc["k"] + x["c"]).alias("k"), x["d"].alias("r")))
        .otherwise(acc))
    found = near_rows.withColumn("__reach", reach).withColumn(
        "__in", F.transform(F.filter("__near", lambda x: x["d"] <= F.col("__reach.r")), lambda x: x["v"]))
    # the ends hold the neighbours themselves, whatever value - radius rounds to
    lo = F.least(F.col("value") - F.col("__reach.r"), F.array_min("__in"))
    hi = F.greatest(F.col("value") + F.col("__reach.r"), F.array_max("__in"))
    ends = found.select(*keys, F.col("value").alias("at"), "cj", "ny", F.col("__reach.k").alias("k"), F.explode(F.array(
        F.struct(lo.alias("value"), F.lit(0).alias("side")), F.struct(hi.alias("value"), F.lit(2).alias("side")))).alias("e")) \
        .select(*keys, "at", "cj", "ny", "k", "e.value", "e.side")
    points = rows.groupBy("feature", "value").agg(F.sum("cj").alias("w"))
    # a low end sorts before the values equal to it, a high end after them
    mixed = ranged(ends.withColumn("w", F.lit(0).cast("long")).unionByName(
        points.withColumn("side", F.lit(1)), allowMissingColumns=True))
    totals = mixed.groupBy("feature", "__bucket").agg(F.sum("w").alias("__t"))
    before = Window.partitionBy("feature").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("feature", "__bucket", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    running = Window.partitionBy("feature", "__bucket").orderBy("value", "side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    below = mixed.withColumn("__run", F.sum("w").over(running)).where("side != 1").join(offsets, ["feature", "__bucket"]) \
        .withColumn("__below", F.col("__run") + F.col("__off"))
    each = below.groupBy(*keys, "at", "cj", "ny", "k").agg(
        (F.max(F.when(F.col("side") == 2, F.col("__below"))) - F.max(F.when(F.col("side") == 0, F.col("__below"))) - 1).alias("m"))
    per = each.groupBy("feature").agg(
        F.sum("cj").alias("n"), F.sum(F.col("cj") * (digamma(F.col("k")) - digamma(F.col("ny")) - digamma(F.col("m")))).alias("s"))
    return per.select("feature", F.greatest(digamma(F.col("n")) + F.col("s") / F.col("n"), F.lit(0.0)).alias("mi"))
