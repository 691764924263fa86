"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (``width`` consecutive words; an item of
fewer words is one window) become the patterns of one automaton over normalised
text: words lower-cased, single spaces between and around them. A slice of
documents is normalised as a whole, scanned once, and every match is mapped
back to words and to character offsets of the original text. A window that
several items hold is one pattern with a list of items.

The automaton travels as its patterns. Their bytes are summed first: up to
``PART_BYTES`` they are one broadcast; beyond it the windows are dealt by hash
into parts of about that size, and the documents are scanned once for each part, each
pass adding to the hits of the one before (written to the shared folder in
between), so a worker never holds more than one part.

Edge cases: a NULL text has no words and no hits; items with a NULL text or no
words have no window; an item with a NULL id still hits words but is not
listed; repeated rows are scanned each; an empty benchmark hits nothing; extra
columns are not read. A text is scanned whole, however long: a task's memory is
bounded by a slice of ``chunks.SLICE_BYTES`` or the longest text.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import chunks, encoders, folded
from fusionlens.llm.sizing import staged

WIDTH = 10
PART_BYTES = 4 << 20   # of patterns and item ids in one automaton
_WINDOW_ROWS = 4096
_RANGES = "array<struct<start:bigint,end:bigint>>"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window`` (words joined by one space) and ``items`` (sorted ids as text) of every distinct window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _WORD.findall(text.encode().lower())
                n = max(1, len(found) - width + 1) if found else 0
                for i in range(0, n, _WINDOW_ROWS):
                    some = [b" ".join(found[j:j + width]).decode() for j in range(i, min(n, i + _WINDOW_ROWS))]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([name] * len(some), pa.string())],
                                                     ["window", "item"])

    source = items.select(items[id_col].cast("string").alias("item"), items[text_col].alias("text")).where("text IS NOT NULL")
    return source.mapInArrow(run, "window string, item string").groupBy("window").agg(
        F.array_sort(F.collect_set("item")).alias("items"))


class Automaton:
    """The automaton of windows, with the words and the items of each."""

    def __init__(self, patterns: pa.Table):
        import ahocorasick

        window = patterns.column("window").to_pylist()
        lists = patterns.column("items").to_pylist()
        self.words = np.array([w.count(" ") + 1 for w in window], dtype=np.int64)
        self.names = sorted({i for x in lists for i in x})
        number = {name: i for i, name in enumerate(self.names)}
        self.items = np.array([number[i] for x in lists for i in x], dtype=np.int64)
        self.first = np.cumsum([0] + [len(x) for x in lists])
        self.machine = None
        if window:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, w in enumerate(window):  # one letter for each byte
                self.machine.add_word(f" {w} ".encode().decode("latin-1"), i)
            self.machine.make_automaton()

    def matches(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where matches end in normalised text, and their windows."""
        if self.machine is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.fromiter(itertools.chain.from_iterable(
            self.machine.iter(text.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


def normalised(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the form `` w1 w2 w3 `` one after another, and where each word ends in them."""
    size = ends - starts
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    after = np.cumsum(size) + np.arange(1, len(size) + 1) + row
    out = np.full((after[-1] if len(after) else 0) + len(begin), 0x20, dtype=np.uint8)
    out[chunks.ragged(after - size, size)] = folded.LOWER[buf[chunks.ragged(starts, size)]]
    return out, after


def _runs(change: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are covered; first word and end of every covered run, cut at the borders."""
    hit = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[border] = True
    ring = np.concatenate(([False], hit, [False]))
    first = np.flatnonzero(ring[1:-1] & (~ring[:-2] | edge[:-1]))
    last = np.flatnonzero(ring[1:-1] & (~ring[2:] | edge[1:])) + 1
    return hit, first, last


def _scan(table: DataFrame, patterns: DataFrame, kind: str) -> DataFrame:
    """``table`` (doc_id, text, words, items) with the hits of these patterns added."""
    key, sent = uuid.uuid4().hex, table.sparkSession.sparkContext.broadcast(patterns.toArrow())
    schema = f"doc_id {kind}, text string, n_words long, n_hit long, items array<string>, words {_RANGES}, spans {_RANGES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoders.once(("automaton", key), lambda: Automaton(sent.value))
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                yield _scan_slice(part, machine)

    return table.mapInArrow(run, schema)


def _scan_slice(part: pa.RecordBatch, machine: Automaton) -> pa.RecordBatch:
    buf, at = chunks.text_bytes(part.column(1))
    starts, ends, begin = folded.words(buf, at)
    text, after = normalised(buf, starts, ends, begin)
    end, window = machine.matches(text)
    last = np.searchsorted(after, end) + 1
    row = np.searchsorted(begin, last - 1, side="right") - 1
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(change, last - machine.words[window], 1)
    np.add.at(change, last, -1)
    for r, x in enumerate(part.column(2).to_pylist()):  # hits of earlier parts
        for span in x or ():
            change[begin[r] + span["start"]] += 1
            change[begin[r] + span["end"]] -= 1
    hit, first, stop = _runs(change, begin)
    owner = np.searchsorted(begin, first, side="right") - 1
    n = part.num_rows
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32))
    covered = np.concatenate(([0], np.cumsum(hit)))[begin]

    def lists(a: np.ndarray, b: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))

    letters = np.zeros(len(buf) + 1, dtype=np.int64)  # characters before each byte
    if len(first):
        np.cumsum((buf & 0xC0) != 0x80, out=letters[1:])
    base = letters[at[owner]]

    pairs = np.unique(row * max(1, len(machine.words)) + window) if len(row) else np.zeros(0, np.int64)
    r, w = pairs // max(1, len(machine.words)), pairs % max(1, len(machine.words))
    some = machine.first[w + 1] - machine.first[w]
    named = np.unique(np.repeat(r, some) * max(1, len(machine.names)) + machine.items[chunks.ragged(machine.first[w], some)])
    items: list[list[str]] = [[] for _ in range(n)]
    for x in named.tolist():
        items[x // len(machine.names)].append(machine.names[x % len(machine.names)])
    for i, x in enumerate(part.column(3).to_pylist()):
        if x:
            items[i] = sorted({*items[i], *x})
    return pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), pa.array(np.diff(begin)), pa.array(np.diff(covered)),
         pa.array(items, pa.list_(pa.string())), lists(first - begin[owner], stop - begin[owner]),
         lists(letters[starts[first]] - base, letters[ends[stop - 1]] - base)],
        ["doc_id", "text", "n_words", "n_hit", "items", "words", "spans"])


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES,
         keep_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids as text, sorted) and ``spans``.

    ``spans`` are the hit passages as (start, end) characters of the original
    text, ``words`` the same as word numbers. ``keep_text`` returns the text too.
    """
    patterns = staged(windows(items, width, item_id_col, item_text_col), "windows")
    size = patterns.agg(F.sum(F.octet_length("window") + 24 * (1 + F.size("items")))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    table = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                        F.lit(None).cast(_RANGES).alias("words"), F.lit(None).cast("array<string>").alias("items"))
    kind = table.schema["doc_id"].dataType.simpleString()
    for p in range(parts):
        if p:
            table = staged(table.select("doc_id", "text", "words", "items"), "scanned")
        some = patterns.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == p) if parts > 1 else patterns
        table = _scan(table, some, kind)
    return table.select("doc_id", "n_words", "n_hit", "items", "spans", "words", *(["text"] if keep_text else []))


def oracle(width: int = WIDTH) -> str:
    """The contract's rows in DuckDB SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {folded.sql_words('text')} AS w FROM documents),
b AS (SELECT item_id, {folded.sql_words('text')} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {width}) AS k, array_to_string(w[i:i + {width - 1}], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT rid, i, dw.k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""
