"""Repeated passages through super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
smallest hash among its runs of ``MINI`` words (leftmost on ties), so it depends
on the window's words alone. Consecutive windows with one minimiser are a
super-k-mer: they travel as one string of words to the share of that minimiser.

1. Documents are packed into blocks. Each block sends its minimisers to their
   shares, which answer which of them any other super-k-mer has too. The rest
   can not hold a repeated window and stay at home.
2. A block sends each distinct super-k-mer with a shared minimiser once, with
   the smallest id that holds it, as one packed string. A passage that a third
   of all documents hold is one row per block. Where more than ``HOT``
   super-k-mers have one minimiser, they are sent as single windows, dealt by
   the windows' own content, so no share gathers them all.
3. A share sorts its windows by content (hash, then compared byte by byte) and
   finds each window's smallest id. It answers a bit for every window that a
   message's own smallest id is not the first to hold.
4. A block puts the answers together with its own ids: a window goes if its bit
   is set or the document is not the block's first. Words under such windows
   are removed.

Edge cases: a NULL text has no words; a NULL id counts as larger than every id;
rows that repeat an id never remove each other's words; an empty table gives an
empty result; texts shorter than a window lose nothing. Extra columns never
clash: only id and text are read, unless ``carry`` names more, which return in
the struct ``row`` next to the ``text`` as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import blocks, chunks
from fusionlens.llm.sizing import shares as number_of_shares

WINDOW = 13
MINI = 4
SHARE_BYTES = 4 << 20   # of text, whose super-k-mers make a share
HOT = 10_000            # super-k-mers of one minimiser (counted per block) that a share takes
_NO_ID = np.iinfo(np.int64).max


class Hashed:
    """Words of many texts, with hashes of words and of runs of words."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.starts, self.ends, self.row = chunks.words(buf, at)
        starts, ends = self.starts, self.ends
        h = np.zeros(len(starts), dtype=np.uint64)
        cut = 0  # in slices: the hash of a byte takes many
        while cut < len(starts):
            stop = max(cut + 1, int(np.searchsorted(ends, starts[cut] + (1 << 19))))
            low = starts[cut]
            h[cut:stop] = chunks.hashes(buf[low:ends[stop - 1]], starts[cut:stop] - low, ends[cut:stop] - low)
            cut = stop
        self.hash = h
        up, down = chunks.power_tables(len(h) + 1)
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(up[:len(h)] * h, out=total[1:])
        self._total, self._down = total, down

    def run_hash(self, first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hash of the ``n`` words from each of ``first`` on."""
        return chunks.mix((self._total[first + n] - self._total[first]) * self._down[first] + np.uint64(1) * np.asarray(n).astype(np.uint64))


class _Words(Hashed):
    """The same, with the words joined by single spaces."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        super().__init__(buf, at)
        starts = self.starts
        self.size = self.ends - starts
        self.first = np.cumsum(self.size + 1) - (self.size + 1)
        self.text = np.full(int(self.size.sum()) + len(self.size), 32, dtype=np.uint8)
        for i in range(0, len(starts), 1 << 18):
            part = slice(i, i + (1 << 18))
            self.text[chunks.ragged(self.first[part], self.size[part])] = buf[chunks.ragged(starts[part], self.size[part])]
        del self.starts, self.ends

    def span(self, first: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the text of those words begins, and its bytes (without a last space)."""
        last = first + n - 1
        begin = self.first[first]
        return begin, self.first[last] + self.size[last] - begin


def _windows(row: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows, given how many words come before each row."""
    n = np.maximum(np.diff(row) - width + 1, 0)
    return chunks.ragged(row[:-1], n)


def _minimisers(words: _Words, window: np.ndarray, width: int, mini: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and place of each window's minimiser."""
    n = len(words.hash) - mini + 1
    value = words.run_hash(np.arange(n), mini)
    place = np.arange(n)
    span, want = 1, width - mini + 1
    while span < want:  # widths 1, 2, 4, ... up to the window's
        step = min(span, want - span)
        left, right = slice(0, len(value) - step), slice(step, None)
        keep = value[left] <= value[right]
        value, place = np.where(keep, value[left], value[right]), np.where(keep, place[left], place[right])
        span += step
    return value[window], place[window]


class _Block:
    """A block's super-k-mers: the same whenever it is computed."""

    def __init__(self, batch: pa.RecordBatch, width: int, mini: int):
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        self.ids = np.asarray(ids.cast(pa.int64()).fill_null(_NO_ID), dtype=np.int64)
        self.words = words = _Words(*chunks.text_bytes(batch.column(batch.schema.get_field_index("text"))))
        self.width = width
        self.window = window = _windows(words.row, width)
        if not len(window):
            return
        value, place = _minimisers(words, window, width, mini)
        new = np.ones(len(window), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
        self.begin = begin = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1           # super-k-mer of each window
        self.inner = np.arange(len(window)) - begin[self.run]
        self.value = value[begin]

    def minimisers(self, shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimisers, how often each occurs, where each share's begin, and the shares: by share and value."""
        value, times = np.unique(self.value, return_counts=True)
        share = (value % np.uint64(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        value, times, share = value[order], times[order], share[order]
        begin = np.flatnonzero(np.diff(share, prepend=-1))
        return value, times, np.append(begin, len(share)), share[begin]

    def contents(self) -> None:
        """Distinct super-k-mers, each with the smallest id that holds it."""
        words, begin = self.words, self.begin
        self.doc = self.ids[np.searchsorted(words.row, self.window, side="right") - 1]
        count = np.diff(np.append(begin, len(self.window)))
        n_words, first = count + self.width - 1, self.window[begin]
        _, kind = np.unique(words.run_hash(first, n_words), return_inverse=True)
        self.kind = kind = self._checked(kind, first, n_words)  # content of each super-k-mer
        order = np.lexsort((self.doc[begin], kind))
        head = order[np.flatnonzero(np.diff(kind[order], prepend=-1))]  # first by id of each content
        self.low, self.first, self.n_words, self.count = self.doc[begin[head]], first[head], n_words[head], count[head]
        self.content_value = self.value[head]
        self.bit = np.cumsum(self.count) - self.count   # first window of each content among all

    def _checked(self, kind: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Contents that share a hash but not their bytes get numbers of their own."""
        chosen = np.zeros(int(kind.max()) + 1, dtype=np.int64)
        chosen[kind] = np.arange(len(kind))
        twin = chosen[kind]
        other = np.flatnonzero(twin != np.arange(len(kind)))
        a, n = self.words.span(first[other], n_words[other])
        b, m = self.words.span(first[twin[other]], n_words[twin[other]])
        same = n == m
        same[same] = chunks.same_bytes(self.words.text, a[same], b[same], n[same])
        wrong = other[~same]
        if len(wrong):
            kind = kind.copy()
            kind[wrong] = len(chosen) + np.arange(len(wrong))
            _, kind = np.unique(kind, return_inverse=True)
        return kind


_VALUES = "block long, share long, value binary, times binary"
_FLAGS = "block long, share long, flags binary"
_MESSAGE = "block long, share long, single boolean, low binary, size binary, text binary, place binary"
_ANSWER = "block long, single boolean, place binary, bits binary"


def _send_values(number: int, batch: pa.RecordBatch, shares: int, width: int, mini: int) -> pa.Table:
    block = _Block(batch, width, mini)
    value, times, at, names = block.minimisers(shares) if len(block.window) else ([], [], [0], [])
    parts = list(zip(at[:-1], at[1:]))
    return pa.table({
        "block": pa.array([number] * len(parts), pa.int64()), "share": pa.array(names, pa.int64()),
        "value": pa.array([value[a:b].tobytes() for a, b in parts], pa.binary()),
        "times": pa.array([blocks.packed(times[a:b].astype(np.uint32))[0] for a, b in parts], pa.binary())})


def _flag(table: pa.Table, hot: int) -> pa.Table:
    """For each block's minimisers: 0 if no other super-k-mer has it, 1 if one does, 2 if very many do."""
    values = [np.frombuffer(v, np.uint64) for v in table.column("value").to_pylist()]
    times = np.concatenate([blocks.unpacked(t, np.uint32) for t in table.column("times").to_pylist()])
    _, kind = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(kind, weights=times)
    flags = np.where(total > hot, 2, np.where(total > 1, 1, 0)).astype(np.uint8)[kind]
    ends = np.cumsum([len(v) for v in values])
    rows = [i for i, (v, e) in enumerate(zip(values, ends)) if flags[e - len(v):e].any()]
    return pa.table({
        "block": table.column("block").take(pa.array(rows, pa.int64())),
        "share": table.column("share").take(pa.array(rows, pa.int64())),
        "flags": pa.array([blocks.packed(flags[ends[i] - len(values[i]):ends[i]])[0] for i in rows], pa.binary())})


def _send(number: int, batch: pa.RecordBatch, answers: pa.Table, shares: int, width: int, mini: int) -> pa.Table:
    """Super-k-mers with shared minimisers, by the minimiser; with hot ones, their windows by their content."""
    block, rows = _Block(batch, width, mini), []
    if len(block.window):
        value, _, at, names = block.minimisers(shares)
        flag = np.zeros(len(value), dtype=np.uint8)
        begin = dict(zip(names.tolist(), at[:-1].tolist()))
        for share, data in zip(answers.column("share").to_pylist(), answers.column("flags").to_pylist()):
            flags = blocks.unpacked(data, np.uint8)
            flag[begin[share]:begin[share] + len(flags)] = flags
        block.contents()
        order = np.argsort(value)
        found = flag[order][np.searchsorted(value[order], block.content_value)]
        whole = np.flatnonzero(found == 1)
        rows += _by_share(block, (block.content_value[whole] % np.uint64(shares)).astype(np.int64),
                          block.first[whole], block.n_words[whole], block.low[whole], whole, False)
        cut = np.flatnonzero(found == 2)
        single = chunks.ragged(block.first[cut], block.count[cut])
        rows += _by_share(block, (block.words.run_hash(single, width) % np.uint64(shares)).astype(np.int64),
                          single, np.full(len(single), width), np.repeat(block.low[cut], block.count[cut]),
                          chunks.ragged(block.bit[cut], block.count[cut]), True)
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.table({
        "block": pa.array([number] * len(rows), pa.int64()), "share": pa.array(cols[0], pa.int64()),
        "single": pa.array(cols[1], pa.bool_()),
        **{name: pa.array([blocks.packed(x)[0] for x in col], pa.binary())
           for name, col in zip(("low", "size", "text", "place"), cols[2:])}})


def _by_share(block: _Block, share, first, n_words, low, place, single: bool) -> list[tuple]:
    """Rows of (share, single, low, size, text, place)."""
    order = np.argsort(share, kind="stable")
    begin, size = block.words.span(first, n_words)
    at = np.flatnonzero(np.diff(share[order], prepend=-1))
    out = []
    for a, b in zip(at, np.append(at[1:], len(order))):
        i = order[a:b]
        out.append((int(share[i[0]]), single, low[i], size[i].astype(np.uint32),
                    block.words.text[chunks.ragged(begin[i], size[i])], place[i].astype(np.uint32)))
    return out


class _Read:
    """Windows of messages."""

    def __init__(self, low: list[bytes], size: list[bytes], text: list[bytes], width: int):
        lows = [blocks.unpacked(x, np.int64) for x in low]
        sizes = [blocks.unpacked(x, np.uint32).astype(np.int64) for x in size]
        at = np.concatenate([np.zeros(1, np.int64), *sizes])
        self.words = _Words(np.concatenate([blocks.unpacked(x, np.uint8) for x in text]), np.cumsum(at))
        self.window = _windows(self.words.row, width)
        owner = np.searchsorted(self.words.row, self.window, side="right") - 1
        self.low = np.concatenate(lows)[owner]
        self.hash = self.words.run_hash(self.window, width)
        self.ends = np.searchsorted(owner, np.cumsum([len(x) for x in sizes]))  # windows up to each message's end


def _answer(table: pa.Table, width: int) -> pa.Table:
    """Bits of the windows that another message's smaller id holds too."""
    read = _Read(*(table.column(c).to_pylist() for c in ("low", "size", "text")), width)
    h, low = read.hash, read.low
    order = np.lexsort((low, h))
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[order[1:]] != h[order[:-1]])))
    head = np.repeat(order[new], np.diff(np.append(new, len(h))))
    bits = np.zeros(len(h), dtype=bool)
    bits[order] = low[order] > low[head]
    first = np.empty(len(h), dtype=np.int64)
    first[order] = head
    told = np.flatnonzero(bits)
    a, n = read.words.span(read.window[told], width)
    b, m = read.words.span(read.window[first[told]], width)
    same = n == m
    same[same] = chunks.same_bytes(read.words.text, a[same], b[same], n[same])
    if not same.all():  # two contents with one hash: those windows by their bytes
        wrong = np.isin(h, h[told[~same]])
        lowest: dict[bytes, int] = {}
        a, n = read.words.span(read.window, width)
        key = {i: read.words.text[a[i]:a[i] + n[i]].tobytes() for i in np.flatnonzero(wrong).tolist()}
        for i, k in key.items():
            lowest[k] = min(lowest.get(k, _NO_ID), int(low[i]))
        for i, k in key.items():
            bits[i] = low[i] > lowest[k]
    rows = [i for i, (x, y) in enumerate(zip([0, *read.ends[:-1]], read.ends)) if bits[x:y].any()]
    ends = [0, *read.ends]
    return pa.table({
        "block": table.column("block").take(pa.array(rows, pa.int64())),
        "single": table.column("single").take(pa.array(rows, pa.int64())),
        "place": table.column("place").take(pa.array(rows, pa.int64())),
        "bits": pa.array([np.packbits(bits[ends[i]:ends[i + 1]]).tobytes() for i in rows], pa.binary())})


def _remove(batch: pa.RecordBatch, answers: pa.Table, width: int, mini: int, carry: bool) -> pa.Table:
    block = _Block(batch, width, mini)
    words = block.words
    gone = np.zeros(len(words.size) + 1, dtype=np.int32)
    if len(block.window):
        block.contents()
        elsewhere = np.zeros(int(block.count.sum()), dtype=bool)
        for single, place, bits in zip(*(answers.column(c).to_pylist() for c in ("single", "place", "bits"))):
            where = blocks.unpacked(place, np.uint32).astype(np.int64)
            if not single:
                where = chunks.ragged(block.bit[where], block.count[where])
            elsewhere[where[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(where)).astype(bool)]] = True
        kind = block.kind[block.run]
        hit = elsewhere[block.bit[kind] + block.inner] | (block.doc > block.low[kind])
        np.add.at(gone, block.window[hit], 1)
        np.add.at(gone, block.window[hit] + width, -1)
    kept = np.cumsum(gone[:-1]) == 0
    n_words = np.diff(words.row)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))[words.row]
    n_kept = np.diff(before)
    size = words.size[kept] + 1
    some = n_kept > 0
    size[before[1:][some] - 1] -= 1  # no space after a row's last word
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[before]
    first = words.first[kept]
    text = np.concatenate([np.zeros(0, np.uint8)] + [
        words.text[chunks.ragged(first[i:i + (1 << 18)], size[i:i + (1 << 18)])] for i in range(0, len(size), 1 << 18)])
    kept_text = pa.Array.from_buffers(pa.large_string(), len(n_words), [None, pa.py_buffer(ends), pa.py_buffer(text)])
    out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words), "n_removed": pa.array(n_words - n_kept),
           "kept_text": kept_text.cast(pa.string())}
    return pa.table(out | ({"text": batch.column("text"), "row": batch.column("row")} if carry else {}))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
                   mini: int = MINI, carry: list[str] | None = None, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` of each row (and ``text``, ``row``)."""
    shares = number_of_shares(docs, text_col, share_bytes)
    table, hot = blocks.blocked(docs, id_col, text_col, carry), HOT
    values = blocks.each(lambda number, rows: _send_values(number, rows, shares, width, mini), _VALUES, table)
    flags = values.groupBy("share").applyInArrow(lambda found: _flag(found, hot), _FLAGS)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        number, rows = left.column("block")[0].as_py(), blocks.rows_of(left.column("data")[0].as_py())
        return _send(number, rows, right, shares, width, mini)

    # both cogroups read the same exchange of blocks
    sent = table.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(send, _MESSAGE)
    answers = sent.groupBy("share").applyInArrow(lambda found: _answer(found, width), _ANSWER)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        return _remove(blocks.rows_of(left.column("data")[0].as_py()), right, width, mini, bool(carry))

    kind = docs.schema[id_col].dataType.simpleString()
    extra = ""
    if carry:
        extra = f", text string, row {docs.select(F.struct(*[docs[c].alias(c) for c in carry])).schema[0].dataType.simpleString()}"
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        remove, f"doc_id {kind}, n_words long, n_removed long, kept_text string{extra}")


def oracle(width: int = WINDOW) -> str:
    """The same results in DuckDB SQL."""
    white = r"[\x20\x09-\x0D]+"
    return f"""
WITH base AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(string_split_regex(coalesce(text, ''), '{white}'), lambda w: w <> '') AS w
  FROM documents),
win AS (
  SELECT rid, coalesce(doc_id, {_NO_ID}) AS d, i, array_to_string(w[i:i + {width - 1}], ' ') AS g
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM base)),
hit AS (SELECT rid, i FROM (SELECT rid, i, d, min(d) OVER (PARTITION BY g) AS low FROM win) WHERE low < d),
gone AS (SELECT DISTINCT rid, i + k AS p FROM hit, range({width}) AS r(k)),
word AS (SELECT rid, p, w[p] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS p FROM base)),
kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (rid)"""
