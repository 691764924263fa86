"""Rolling statistics over a time range before each reading, by prefix sums of powers.

A key of at most ``part_rows`` readings is one group of a task: its readings are shuffled
once, as they are. Readings of a larger key at one second are first added up to one row of power sums
(combined in each task), so a span of ``days`` holds at most 86,400 rows a day however
many readings a key has. Such a key's spans are then cut into parts of about
``part_rows`` such rows, a part gets the span before it as read-only halo rows, and
one task turns a part into its frames in linear time: the sums of a frame are the
difference of two prefix sums (80-bit), its maximum comes from two overlapping runs
of a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.functions.exprs import nan_to_null
from fusionlens.operators import ranks

DAY = 86_400
PART_ROWS = 200_000  # seconds with a reading in a part, besides its last span and the halo
STATS = "rolling_count long, rolling_mean double, rolling_std double, peak_to_average double, rolling_kurtosis double"


def frame_starts(t: np.ndarray, seconds: int) -> np.ndarray:
    """First position of the frame ``[t[i] - seconds, t[i]]`` of every sorted, distinct ``t[i]``."""
    return np.searchsorted(t, t - seconds, side="left")


def frame_max(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``max(x[start[i] : i + 1])`` of every i; a frame is two overlapping runs of 2^k values."""
    at = np.arange(len(x))
    level = np.log2(at - start + 1).astype(np.int64)
    out, run = x.copy(), x
    for k in range(int(level.max(initial=0)) + 1):
        here = at[level == k]
        out[here] = np.maximum(run[start[here]], run[here + 1 - (1 << k)])
        run = np.maximum(run[: -(1 << k)], run[1 << k:])
    return out


def frame_stats(t: np.ndarray, sums: np.ndarray, top: np.ndarray, shift: float, seconds: int) -> list[pa.Array]:
    """The five statistics of the frame ending at each second, in the order of ``STATS``.

    ``sums`` holds count and sums of the first to fourth power of the signal less ``shift``,
    ``top`` the largest such value, a column per second.
    """
    start = frame_starts(t, seconds)
    prefix = np.zeros((5, len(t) + 1), dtype=np.longdouble)
    np.cumsum(sums, axis=1, out=prefix[:, 1:])
    n, s1, s2, s3, s4 = prefix[:, 1:] - prefix[:, start]
    mean = s1 / n
    m2 = s2 / n - mean**2
    m4 = s4 / n - 4 * mean * s3 / n + 6 * mean**2 * s2 / n - 3 * mean**4
    level = (mean + shift).astype(float)
    one, flat = n < 2, (n < 4) | ~(m2 > 1e-12 * (s2 / n))
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.sqrt(np.maximum((s2 - n * mean**2) / (n - 1), 0))
        kurtosis = ((n + 1) * (n - 1) * (m4 / m2**2) - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3))
        peak = (frame_max(top, start) + shift) / level
    return [pa.array(n.astype(np.int64)), pa.array(level), pa.array(std.astype(float), mask=one),
            pa.array(peak, mask=level == 0), pa.array(kurtosis.astype(float), mask=flat)]


def _parts(instants: DataFrame, key: str, part_rows: int) -> DataFrame:
    """(key, __span, __part, __halo): the parts that need a key's span, its own and the one it is the halo of."""
    counts = instants.groupBy(key, "__span").agg(F.count(F.lit(1)).alias("__rows"))
    # a row per span of a key, so a window of a key is bounded by the calendar
    before = F.sum("__rows").over(Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    own = counts.select(key, "__span", F.floor(F.coalesce(before, F.lit(0)) / F.lit(part_rows)).alias("__part"))
    halo = own.groupBy(key, "__part").agg((F.min("__span") - 1).alias("__span")).where("__part > 0").select(key, "__span", "__part")
    return own.withColumn("__halo", F.lit(False)).unionByName(halo.withColumn("__halo", F.lit(True)))


def rolling_stats(df: DataFrame, signal: str, key: str, days: int = 7, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per reading: count, mean, deviation, peak to average and unbiased excess kurtosis (as a rolling
    pandas kurt: four readings and a spread) of its key's readings in the ``days`` before it, ties included.

    Rows without a time, and missing, NaN or infinite readings are left out; a NULL key is a key. An empty
    table gives no rows. A key of more than ``part_rows`` readings is many tasks: its readings are combined per
    second before they are shuffled, and its spans of ``days`` are dealt to parts.
    """
    seconds = F.col("event_time").cast("timestamp").cast("long")
    rows = df.select(F.col(key), "event_time", nan_to_null(F.col(signal).cast("double")).alias("__v")).where(
        seconds.isNotNull() & (F.abs("__v") < float("inf")))
    # read several times below, and as short as its three columns
    rows = ranks.staged(rows).withColumn("__t", seconds)
    # less the floor of the global mean, the power sums stay well conditioned
    shift = rows.agg(F.floor(F.avg("__v")).cast("double")).first()[0] or 0.0
    # at most one key in part_rows readings
    large = ranks.staged(rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > part_rows).select("__key"))
    if large.isEmpty():
        found = _whole_keys(rows, key, days, shift)
    else:
        same = F.col(key).eqNullSafe(F.col("__key"))
        found = _whole_keys(rows.join(F.broadcast(large), same, "left_anti"), key, days, shift).unionByName(
            _parted_keys(rows.join(F.broadcast(large), same, "left_semi"), key, days, part_rows, shift))
    return found.withColumnRenamed("__v", signal)


def _whole_keys(rows: DataFrame, key: str, days: int, shift: float) -> DataFrame:
    """Keys of at most ``part_rows`` readings, each in one task: the readings themselves are shuffled, once."""
    names = [f.split()[0] for f in STATS.split(", ")]

    def frames(group: pa.Table) -> pa.Table:
        group = group.sort_by("__t")
        t, x = group.column("__t").to_numpy(), group.column("__v").to_numpy() - shift
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        sums = np.stack([np.add.reduceat(x**p, first) for p in range(5)])
        stats = pa.table(frame_stats(t[first], sums, np.maximum.reduceat(x, first), shift, days * DAY), names=names)
        each = stats.take(pa.array(np.repeat(np.arange(len(first)), np.diff(first, append=len(t)))))
        return pa.table([*(group.column(c) for c in kept), *each.columns], names=[*kept, *names])

    kept = [key, "event_time", "__v"]
    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInArrow(frames, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", {STATS}")


def _parted_keys(rows: DataFrame, key: str, days: int, part_rows: int, shift: float) -> DataFrame:
    """Larger keys: added up per second before they are shuffled, their spans dealt to parts."""
    x = F.col("__v") - F.lit(shift)
    instants = rows.groupBy(key, "__t").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x**p).alias(f"s{p}") for p in (1, 2, 3, 4)],
        F.max(x).alias("top")).withColumn("__span", F.floor(F.col("__t") / F.lit(days * DAY)))
    parts = _parts(instants, key, part_rows).withColumnsRenamed({key: "__key", "__span": "__on"})
    dealt = instants.join(parts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__span") == F.col("__on"))).select(
        "__key", "__part", "__halo", "__t", "n", "s1", "s2", "s3", "s4", "top")

    def frames(group: pa.Table) -> pa.Table:
        group = group.sort_by("__t")
        column = lambda c: group.column(c).to_numpy()
        stats = frame_stats(column("__t"), np.stack([column(c) for c in ("n", "s1", "s2", "s3", "s4")]), column("top"),
                            shift, days * DAY)
        names = [f.split()[0] for f in STATS.split(", ")]
        out = pa.table([group.column("__key"), group.column("__t"), *stats], names=["__key", "__at", *names])
        return out.filter(pc.invert(group.column("__halo")))

    kind = rows.schema[key].dataType.simpleString()
    ready = dealt.groupBy("__key", "__part").applyInArrow(frames, f"__key {kind}, __at long, {STATS}")
    joined = rows.join(ready, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__t") == F.col("__at")))
    return joined.select(key, "event_time", "__v", "rolling_count", "rolling_mean", "rolling_std", "peak_to_average", "rolling_kurtosis")
