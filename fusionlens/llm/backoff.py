"""Stupid-backoff language-model scores.

n-gram counts of the whole corpus are tables partitioned by a hash of the
n-gram; the n-grams of every document are joined to them and summed for each
document. Rows that meet in the join are packed: a block of documents sends
each distinct n-gram once with its count to the share of its hash, the share
adds up the counts of all blocks and answers with the totals, and the block
looks up every position of its documents. So a word that a third of all
positions hold is one row per block, and no group is larger than its share.
Words and pairs of words travel first. Another block can only hold a longer
n-gram if it holds every shorter one in it, so in two more rounds (order 3, then
the longer ones) just those n-grams travel; the total of any other is the
block's own count.

A word scores the relative frequency of the longest n-gram that ends in it and
occurs, c(n-gram) / c(context), times ``ALPHA`` for each order given up; a word
by itself scores c(word) / N. A word that never occurs gives up one order more
and counts as one occurrence. Without a corpus of its own a document is scored
by all *other* documents: its own counts are subtracted everywhere (N too).

n-grams are told apart by 64-bit hashes; logarithms are rounded to 1e-6, so
sums do not depend on order or partitioning.

Edge cases: a NULL or empty text has no words: ``log_score`` 0 and NULL
``mean_log_score``; NULL ids are carried through; repeated rows score alike (the
others count for each); an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import blocks
from fusionlens.llm.chunks import text_bytes
from fusionlens.llm.sizing import shares as number_of_shares
from fusionlens.llm.sizing import staged
from fusionlens.llm.super_kmers import Hashed

ALPHA = 0.4
ORDER = 5
SHARE_BYTES = 6 << 20   # text whose n-grams make a share
UNIT = 1_000_000        # logarithms are whole numbers of 1 / UNIT


def _times(values: np.ndarray) -> np.ndarray:
    """How often each value occurs, at each of its places."""
    _, kind, count = np.unique(values, return_inverse=True, return_counts=True)
    return count[kind]


class _Grams:
    """Distinct n-grams of a block by order: the same whenever they are computed.

    An n-gram occurs once if one of its two shorter ones does, so of orders above 2 only the others are
    sorted: n-grams that may repeat come first, by hash, then those that occur once, by place.
    """

    def __init__(self, batch: pa.RecordBatch, order: int):
        self.words = words = Hashed(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
        self.row = words.row
        self.n = len(words.hash)
        del words.starts, words.ends, words.hash
        starts = np.arange(self.n, dtype=np.int32)  # a block has less than 2^31 bytes
        left = np.repeat(words.row[1:], np.diff(words.row)) - starts  # words from here to the row's end
        self.starts = [starts[left >= k] for k in range(1, order + 1)]
        self.sorted, self.single, self.kind, self.count = [], [], [], []
        for k, s in enumerate(self.starts, 1):
            if k <= 2:
                single = s[:0]
                keys, kind, count = np.unique(words.run_hash(s, k), return_inverse=True, return_counts=True)
                kind = kind.astype(np.int32)
            else:
                often = np.zeros(self.n + 1, dtype=bool)
                often[self.starts[k - 2]] = (self.count[-1] > 1)[self.kind[-1]]
                often[:-1] &= often[1:]
                often = often[s]
                at, once = np.flatnonzero(often), np.flatnonzero(~often)
                single = s[once]
                keys, found, times = np.unique(words.run_hash(s[at], k), return_inverse=True, return_counts=True)
                kind = np.empty(len(s), dtype=np.int32)
                kind[at], kind[once] = found, len(keys) + np.arange(len(once))
                count = np.concatenate((times, np.ones(len(single), dtype=times.dtype)))
            for held, x in zip((self.sorted, self.single, self.kind, self.count), (keys, single, kind, count)):
                held.append(x)

    def keys(self, k: int, chosen: np.ndarray) -> np.ndarray:
        """Hashes of the chosen n-grams of order ``k``."""
        known = len(self.sorted[k - 1])
        return np.concatenate((self.sorted[k - 1][chosen[:known]],
                               self.words.run_hash(self.single[k - 1][chosen[known:]], k)))

    def linked(self, total: list[np.ndarray], base: list[np.ndarray], known: int, k: int) -> np.ndarray:
        """Which n-grams of order ``k`` hold only n-grams of order ``known`` that other blocks have too."""
        shared = np.zeros(self.n + 1, dtype=bool)
        shared[self.starts[known - 1]] = (total[known - 1] > base[known - 1])[self.kind[known - 1]]
        whole = shared.copy()
        for i in range(1, k - known + 1):
            whole[:-i] &= shared[i:]
        keys = np.zeros(len(self.count[k - 1]), dtype=bool)
        keys[self.kind[k - 1][np.flatnonzero(whole[self.starts[k - 1]])]] = True
        return keys


class _Sent:
    """The n-grams of a block that travel in one round, sorted by hash and cut by share."""

    def __init__(self, grams: _Grams, orders: range, chosen: list[np.ndarray], shares: int):
        self.orders, self.chosen = orders, chosen
        keys = np.concatenate([grams.keys(k, c) for k, c in zip(orders, chosen)])
        self.sort = np.argsort(keys, kind="stable" if orders.start == 1 else None)  # sorted runs are merged
        self.keys = keys[self.sort]
        share = ((self.keys >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(share, prepend=-1))
        self.at, self.shares = np.append(begin, len(share)), share[begin]  # equal ranges of the hash

    def by_share(self, parts: list[np.ndarray]) -> np.ndarray:
        """Numbers of the chosen n-grams, one array per order, in the order of the hash."""
        return np.concatenate([x[c] for x, c in zip(parts, self.chosen)])[self.sort]

    def fill(self, total: list[np.ndarray], answers: dict[int, np.ndarray]) -> None:
        """Answers of the shares put into ``total``."""
        found = np.zeros(len(self.keys), dtype=np.int64)
        for a, b, share in zip(self.at[:-1].tolist(), self.at[1:].tolist(), self.shares.tolist()):
            found[a:b] = answers[share]
        back = np.empty_like(found)
        back[self.sort] = found
        place = 0
        for k, c in zip(self.orders, self.chosen):
            n = int(c.sum())
            total[k - 1][c] = back[place:place + n]
            place += n


_SENT = "block long, share long, keys binary, counts binary, words long"
_TOTALS = "block long, share long, totals binary, words long"


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as the bytes of their differences, the high bytes (mostly 0) side by side."""
    return blocks.packed(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)[0]


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = blocks.unpacked(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _everything(grams: _Grams, orders: range) -> list[np.ndarray]:
    return [np.ones(len(grams.count[k - 1]), dtype=bool) for k in orders]


def _message(block: int | None, sent: _Sent, count: np.ndarray, words: np.ndarray) -> pa.Table:
    parts = list(zip(sent.at[:-1].tolist(), sent.at[1:].tolist()))
    return pa.table({
        "block": pa.array([block] * len(parts), pa.int64()),
        "share": pa.array(sent.shares, pa.int64()),
        "keys": pa.array([_pack_keys(sent.keys[a:b]) for a, b in parts], pa.binary()),
        "counts": pa.array([blocks.packed(count[a:b])[0] for a, b in parts], pa.binary()),
        "words": pa.array([int(words[a:b].sum()) for a, b in parts], pa.int64())})


def _send(block: int | None, grams: _Grams, sent: _Sent, counted: bool) -> pa.Table:
    count = sent.by_share([grams.count[k - 1] * counted for k in sent.orders]).astype(np.uint32)
    words = sent.by_share([grams.count[k - 1] * (counted and k == 1) for k in sent.orders])
    return _message(block, sent, count, words)


def _rounds(order: int) -> list[range]:
    """Orders that travel together: 1 and 2, then 3, then the longer ones."""
    cuts = [1, 3, 4, order + 1]
    return [range(a, min(b, order + 1)) for a, b in zip(cuts, cuts[1:]) if a <= order]


def _round(grams: _Grams, orders: range, shares: int, total: list[np.ndarray], base: list[np.ndarray]) -> _Sent:
    """Other blocks can only have n-grams whose shorter ones, known from the rounds before, they have."""
    known = orders.start - 1
    chosen = [grams.linked(total, base, known, k) for k in orders] if known else _everything(grams, orders)
    return _Sent(grams, orders, chosen, shares)


def _base(grams: _Grams, others: bool) -> list[np.ndarray]:
    """Totals of n-grams that stay at home: no other block holds them."""
    return [c if others else np.zeros_like(c) for c in grams.count]


def _filled(grams: _Grams, answers: pa.Table, rounds: list[range], shares: int, others: bool) -> tuple[list, list]:
    """Totals and base of a block's n-grams after these rounds."""
    base = _base(grams, others)
    total = [b.copy() for b in base]
    found: list[dict[int, np.ndarray]] = [{} for _ in rounds]
    for r, share, data in zip(*(answers.column(c).to_pylist() for c in ("round", "share", "totals"))):
        found[r][share] = blocks.unpacked(data, np.int64)
    for orders, answer in zip(rounds, found):
        _round(grams, orders, shares, total, base).fill(total, answer)
    return total, base


def _totals(table: pa.Table) -> pa.Table:
    """The count table of a share, as each block's n-grams see it; the share's words in a row of its own."""
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    counts = [blocks.unpacked(c, np.uint32) for c in table.column("counts").to_pylist()]
    _, kind = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(kind, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    share, words = table.column("share")[0].as_py(), sum(table.column("words").to_pylist())
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
        "share": pa.array([share] * (len(keys) + 1), pa.int64()),
        "totals": pa.array([blocks.packed(total[kind[e - len(k):e]])[0] for k, e in zip(keys, ends)] + [None], pa.binary()),
        "words": pa.array([None] * len(keys) + [words], pa.int64())})


def _next(block: int, batch: pa.RecordBatch, answers: pa.Table, rounds: list[range], shares: int, others: bool) -> pa.Table:
    """What a block sends in the last of ``rounds``, once it knows the totals of those before."""
    grams = _Grams(batch, rounds[-1].stop - 1)
    total, base = _filled(grams, answers, rounds[:-1], shares, others)
    return _send(block, grams, _round(grams, rounds[-1], shares, total, base), others)


def _scores(batch: pa.RecordBatch, answers: pa.Table, order: int, shares: int, everything: int, others: bool) -> pa.Table:
    grams = _Grams(batch, order)
    total, _ = _filled(grams, answers, _rounds(order), shares, others)
    n_words = np.diff(grams.row)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    size = np.maximum((everything - n_words * others)[owner], 1)
    inside = np.arange(grams.n) - grams.row[:-1][owner]  # words before this one in its row
    longest = np.minimum(inside + 1, order)
    given_up = ALPHA ** np.arange(order + 1)
    before = np.zeros(grams.n, dtype=np.int64)       # occurrences of the n-gram of the order before, at its first word
    repeated = np.ones(grams.n + 1, dtype=bool)      # whether that one is in the document again
    for k, (starts, kind, times, whole) in enumerate(zip(grams.starts, grams.kind, grams.count, total), 1):
        seen = whole[kind]
        if others:  # without the document's own
            own = np.ones(len(starts), dtype=np.int64)
            at = np.flatnonzero(repeated[starts] & (times > 1)[kind])
            own[at] = _times(owner[starts[at]] * len(whole) + kind[at])
            seen = seen - own
            repeated[:] = False
            repeated[starts] = own > 1
        if k == 1:
            ratio = np.maximum(seen, 1) / size * given_up[longest - 1 + (seen <= 0)]
        else:
            found = np.flatnonzero(seen > 0)
            first = starts[found]
            last = first + (k - 1)
            ratio[last] = seen[found] / np.maximum(before[first], 1) * given_up[longest[last] - k]
        before[:] = 0
        before[starts] = seen
    logs = np.concatenate((np.zeros(1), np.cumsum(np.rint(np.log(ratio) * UNIT)))).astype(np.int64)
    whole = logs[grams.row[1:]] - logs[grams.row[:-1]]
    return pa.table({"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words), "units": pa.array(whole)})


def _without_leftovers(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged; its shuffle files go as soon as the table is written, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return staged(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, id_col: str = "doc_id",
          text_col: str = "text", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``log_score``, ``mean_log_score`` of each row of ``docs``.

    Counts come from ``corpus`` if it is given, else from all other rows of ``docs``.
    """
    table = blocks.blocked(docs, id_col, text_col)
    shares = number_of_shares(docs if corpus is None else corpus, text_col, share_bytes)
    others = corpus is None  # closures must not hold a DataFrame
    model = None if others else blocks.blocked(corpus, id_col, text_col)

    rounds = _rounds(order)

    def first(block: int, rows: pa.RecordBatch) -> pa.Table:
        grams = _Grams(rows, rounds[0].stop - 1)
        return _send(block, grams, _round(grams, rounds[0], shares, [], []), others)

    def of_corpus(orders: range):
        def run(block: int, rows: pa.RecordBatch) -> pa.Table:
            grams = _Grams(rows, orders.stop - 1)
            return _send(None, grams, _Sent(grams, orders, _everything(grams, orders), shares), True)
        return run

    def later(upto: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return _next(left.column("block")[0].as_py(), blocks.rows_of(left.column("data")[0].as_py()), right,
                         rounds[:upto + 1], shares, others)
        return run

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(blocks.rows_of(left.column("data")[0].as_py()), right, order, shares, everything, others)

    def with_answers():
        return table.groupBy("block").cogroup(totals.where("block IS NOT NULL").groupBy("block"))

    totals = None
    for r, orders in enumerate(rounds):
        sent = blocks.each(first, _SENT, table) if totals is None else with_answers().applyInArrow(later(r), _SENT)
        if model is not None:
            sent = sent.unionByName(blocks.each(of_corpus(orders), _SENT, model))
        counted = _without_leftovers(sent.groupBy("share").applyInArrow(_totals, _TOTALS), "ngram-totals").withColumn("round", F.lit(r))
        totals = counted if totals is None else totals.unionByName(counted)
    everything = totals.agg(F.sum("words")).first()[0] or 0

    kind = docs.schema[id_col].dataType.simpleString()
    found = with_answers().applyInArrow(scores, f"doc_id {kind}, n_words long, units long")
    return found.select("doc_id", "n_words", (F.col("units") / UNIT).alias("log_score"),
                        F.when(F.col("n_words") > 0, F.col("units") / UNIT / F.col("n_words")).alias("mean_log_score"))


def oracle(order: int = ORDER) -> str:
    """The same scores in DuckDB SQL, without a corpus of its own."""
    white = r"[\x20\x09-\x0D]+"
    longer = range(2, order + 1)
    lags = "".join(f", lag(x1, {i}) OVER (PARTITION BY rid ORDER BY p) AS l{i}" for i in range(1, order))
    before = {k: " || ' ' || ".join(f"l{i}" for i in range(k - 1, 0, -1)) for k in longer}  # NULL at a row's beginning
    grams = "".join(f", {before[k]} || ' ' || x1 AS x{k}, {before[k]} AS y{k}" for k in longer)
    tables = "".join(f"""
g{k} AS (SELECT rid, x{k} AS x, count(*) AS own, sum(count(*)) OVER (PARTITION BY x{k}) AS n
       FROM pos WHERE x{k} IS NOT NULL GROUP BY rid, x{k}),""" for k in range(1, order + 1))
    cases = "".join(f"""
    WHEN g{k}.n - g{k}.own > 0 THEN (g{k}.n - g{k}.own) / greatest(c{k}.n - c{k}.own, 1)::DOUBLE
      * power({ALPHA}::DOUBLE, least(pos.p, {order}) - {k})""" for k in reversed(longer))
    joins = "".join(f"""
  LEFT JOIN g{k} ON g{k}.rid = pos.rid AND g{k}.x = pos.x{k}
  LEFT JOIN g{k - 1} AS c{k} ON c{k}.rid = pos.rid AND c{k}.x = pos.y{k}""" for k in longer)
    backed_off = f"""greatest(g1.n - g1.own, 1) / size.n::DOUBLE
      * power({ALPHA}::DOUBLE, least(pos.p, {order}) - 1 + (CASE WHEN g1.n - g1.own <= 0 THEN 1 ELSE 0 END))"""
    return f"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(coalesce(text, ''), '{white}'), lambda w: w <> '') AS w
  FROM documents),
words AS (SELECT rid, unnest(w) AS x1, unnest(range(1, len(w) + 1)) AS p FROM base),
pos AS (SELECT rid, p, x1{grams} FROM (SELECT *{lags} FROM words)),{tables}
size AS (SELECT rid, greatest((SELECT count(*) FROM pos) - len(w), 1) AS n FROM base),
term AS (
  SELECT pos.rid, {f"CASE{cases} ELSE {backed_off} END" if order > 1 else backed_off} AS s
  FROM pos JOIN g1 ON g1.rid = pos.rid AND g1.x = pos.x1 JOIN size ON size.rid = pos.rid{joins}),
units AS (SELECT rid, sum(round_even(ln(s) * {UNIT}, 0))::BIGINT AS u FROM term GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(u, 0) / {UNIT}::DOUBLE AS log_score,
       CASE WHEN len(w) > 0 THEN u / {UNIT}::DOUBLE / len(w) END AS mean_log_score
FROM base LEFT JOIN units USING (rid)"""
