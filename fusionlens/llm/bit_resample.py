"""Importance resampling towards a target by bit-sliced bucket counts.

Features are the runs of one and two consecutive words of a text; each falls
into one of ``BUCKETS`` buckets by the crc32 of its bytes. The counts over all
documents and over the target give every bucket an integer gain (a scaled log
ratio). A document's bucket counts are kept as bit planes: bit i of plane b is
bit b of its count in bucket i. The gains are bit planes too, the highest one
negative. The sum of count times gain is then

    sum over planes b, j of  +-2**(b+j) * popcount(count plane b AND gain plane j),

exact integers throughout. Adding noise (Gumbel, from a hash of the id) to the
weights and taking the highest scores draws without replacement.

Two passes read the texts: one for the counts (a task sends at most ``BUCKETS``
rows), one for the weights. No text is shuffled. Scores are integers of a bounded
range, so the place of every score is known from a table of counts by score,
and only rows drawn are sorted, score by score.

Edge cases: a NULL text has no words; no features give weight 0; a NULL id has
no noise, hence a NULL score, and is never drawn; repeated rows are documents
of their own (ties of score and id are ordered by weight and feature count); empty tables give
gains of 0. A text is read whole: memory is bounded by a slice of texts or the
longest one. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusionlens.llm import chunks, folded
from fusionlens.llm.sizing import staged

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
_LANES = -(-BUCKETS // 64)
_ROWS = 64          # documents of a block
_LONG = 64          # longer words go through zlib one by one
_SPAN = 1 << 20     # table of scores that may be broadcast: rows

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # reflected polynomial of crc32
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _TABLE[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def _shifts() -> np.ndarray:
    """[n, k, v]: the register v << 8k after n zero bytes."""
    table = np.zeros((_LONG + 1, 4, 256), dtype=np.uint32)
    table[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _LONG + 1):
        table[n] = _step(table[n - 1], np.uint32(0))
    return table


_SHIFTS = _shifts()


def feature_buckets(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of these texts, and the words of each row.

    The register of "a b" is that of "a " moved on by the length of b, xor that
    of b: crc32 is linear, so a pair of words costs four table lookups.
    """
    starts, ends, begin = folded.words(buf, at)
    low = folded.LOWER[buf]
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state = np.full(len(size), _ONES, dtype=np.uint32)
    first = starts[order]
    longest = int(size.max()) if len(size) else 0
    falling = -size[order]
    for i in range(min(longest, _LONG)):
        n = int(np.searchsorted(falling, -i, side="left"))  # words of more than i bytes come first
        state[:n] = _step(state[:n], low[first[:n] + i])
    register = np.empty_like(state)
    register[order] = state
    big = np.flatnonzero(size > _LONG)
    raw = [low[starts[w]:ends[w]].tobytes() for w in big.tolist()]
    register[big] = np.array([zlib.crc32(x) for x in raw], dtype=np.uint32) ^ _ONES
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    left = np.flatnonzero(row[1:] == row[:-1])
    moved = _step(register[left], np.uint32(0x20)) ^ _ONES
    n = np.minimum(size[left + 1], _LONG)
    pair = register[left + 1].copy()
    for k in range(4):
        pair ^= _SHIFTS[n, k, (moved >> np.uint32(8 * k)) & 0xFF]
    for word, x in zip(big.tolist(), raw):
        i = int(np.searchsorted(left, word - 1))
        if word and i < len(left) and left[i] == word - 1:  # moved is the crc32 of "a "
            pair[i] = zlib.crc32(x, int(moved[i])) ^ 0xFFFFFFFF
    both = np.concatenate((register, pair)) ^ _ONES
    return np.concatenate((row, row[left])), (both % np.uint32(BUCKETS)).astype(np.int64), np.diff(begin)


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of the whole table fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                _, bucket, _ = feature_buckets(*chunks.text_bytes(part.column(0)))
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(texts[text_col].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + BUCKETS)) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Two's complement bit planes, the last one negative, as 64-bit lanes."""
    bits = max(int(gain.max()).bit_length(), int(-gain.min() - 1).bit_length() if gain.min() < 0 else 0) + 1
    padded = np.zeros((bits, _LANES * 64), dtype=np.uint8)
    padded[:, :BUCKETS] = (gain[None, :] >> np.arange(bits)[:, None]) & 1
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def count_planes(row: np.ndarray, bucket: np.ndarray, n_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(b, rows that have bit b in some count, plane b of those rows)."""
    counts = np.bincount(row * BUCKETS + bucket, minlength=n_rows * BUCKETS)
    at = np.flatnonzero(counts)
    n = counts[at]
    owner, place = at // BUCKETS, at % BUCKETS
    lane, bit = place >> 5, np.ldexp(1.0, (place & 31).astype(np.int32))
    for b in range(int(n.max()).bit_length() if len(n) else 0):
        on = np.flatnonzero(n >> b & 1)
        rows, number = np.unique(owner[on], return_inverse=True)
        # every bucket is one bit, so a sum of distinct powers of two (below 2**32, exact) is their union
        half = np.bincount(number * (2 * _LANES) + lane[on], weights=bit[on], minlength=len(rows) * 2 * _LANES)
        yield b, rows, half.astype(np.uint32).view(np.uint64).reshape(len(rows), _LANES)


def gain_sums(row: np.ndarray, bucket: np.ndarray, n_rows: int, planes: np.ndarray) -> np.ndarray:
    """The sum of gains over the features of each row."""
    total = np.zeros(n_rows, dtype=np.int64)
    for b, rows, plane in count_planes(row, bucket, n_rows):
        for j, gain in enumerate(planes):
            ones = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << (b + j)
            total[rows] += -ones if j == len(planes) - 1 else ones
    return total


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` (floored mean gain) of each document."""
    planes = docs.sparkSession.sparkContext.broadcast(gain_planes(gain))  # BUCKETS bits a plane
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                row, bucket, n_words = feature_buckets(*chunks.text_bytes(part.column(1)))
                order = np.argsort(row, kind="stable")
                row, bucket = row[order], bucket[order]
                n = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(part.num_rows, dtype=np.int64)
                for i in range(0, part.num_rows, _ROWS):
                    a, b = np.searchsorted(row, (i, i + _ROWS))
                    some = min(_ROWS, part.num_rows - i)
                    total[i:i + some] = gain_sums(row[a:b] - i, bucket[a:b], some, planes.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "n_words", "n_features", "weight"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Scaled and floored Gumbel noise from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Every document with ``n_features``, ``n_words``, ``weight``, ``score`` and ``rank`` (NULL if not drawn)."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    scored = staged(weigh(docs, gain, id_col, text_col).withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn(
        "able", (F.col("n_words") >= min_words) & F.col("score").isNotNull()), "scores")
    # how many rows are above each score: counts by score, summed within and over ranges of 1024 scores
    by_score = staged(scored.where("able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "range", F.shiftright("score", 10)), "score-counts")
    ranges = by_score.groupBy("range").agg(F.sum("n").alias("n")).collect()  # scores span gains plus noise: a few hundred ranges
    want = percent * sum(r["n"] for r in ranges) // 100
    above, tops = 0, []
    for r in sorted(ranges, key=lambda r: -r["range"]):
        tops.append((r["range"], above))
        above += r["n"]
    tops = scored.sparkSession.createDataFrame(tops, "range long, above long")
    inside = Window.partitionBy("range").orderBy(F.desc("score"))
    places = by_score.join(F.broadcast(tops), "range").select(
        "score", (F.col("above") + F.sum("n").over(inside) - F.col("n")).alias("above")).where(F.col("above") < want)
    if int(gain.max() - gain.min()) + 26_100 <= _SPAN:  # noise lies between -3,136 and 22,873
        places = F.broadcast(places)
    placed = scored.join(places, "score", "left").withColumn("drawn", F.col("able") & F.col("above").isNotNull())
    order = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features", "n_words")
    rank = F.col("above") + F.row_number().over(order)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = placed.where("drawn").withColumn("rank", rank).select(
        *columns, F.when(F.col("rank") <= want, F.col("rank")).alias("rank"))
    return drawn.unionByName(placed.where("NOT drawn").select(*columns, F.lit(None).cast("long").alias("rank")))


def oracle(percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> str:
    """The contract's rows in DuckDB SQL; crc32 byte by byte over the distinct features."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {folded.sql_words('text')} AS w FROM documents),
b AS (SELECT {folded.sql_words('text')} AS w FROM benchmark),
df AS (
  SELECT rid, unnest(w) AS f FROM d UNION ALL
  SELECT rid, w[i] || ' ' || w[i + 1] FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
bf AS (
  SELECT unnest(w) AS f FROM b UNION ALL
  SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM b)),
poly AS (
  SELECT list(list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z:
    CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY v) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS v)),
crc AS (
  SELECT f, (xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
      lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8)), 4294967295::BIGINT) % {BUCKETS})::BIGINT AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM bf), poly),
s AS (SELECT bucket, count(*) AS n FROM df JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN crc USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM df) + {BUCKETS}))::DOUBLE
    / ((s.n + 1) * ((SELECT count(*) FROM bf) + {BUCKETS}))::DOUBLE))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)),
weight AS (
  SELECT rid, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight
  FROM df JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY rid),
scored AS (
  SELECT doc_id, len(w) >= {min_words} AS able, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (rid)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY able) AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= {percent} * n // 100 THEN r END::BIGINT AS rank
FROM ranked"""
