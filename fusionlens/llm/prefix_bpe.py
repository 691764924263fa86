"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a byte string there is one token that its encoding ends
with. ``PrefixEncoder`` stores that token for each prefix: the encoding of a
longer prefix ends in the longest vocabulary string whose predecessor, the
stored token of what is left, is a neighbour that merging would leave apart.
Reading the stored tokens back from the end gives the encoding. Appending bytes
extends the table; an edit keeps every prefix before it, so only what follows
is computed again.

Texts are cut by the pattern of the rank file; each distinct piece is encoded
once for a worker's bounded memory.

Edge cases: a NULL text is an empty text (no ids); NULL ids are carried
through; special strings are ordinary text; repeated rows give repeated
results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fusionlens.llm import chunks, encoders

# Fixed value: what the pattern's \s stands for, in the library's Unicode tables.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Merging by definition: the lowest-ranked neighbours first, until none ranks lower than ``below``."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int] | None]:
    """The two tokens each token is merged from; None for a token that merging never makes."""
    out: dict[int, tuple[int, int] | None] = {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = merged(token, ranks, rank)
            out[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
    return out


class PrefixEncoder:
    """The last token of every prefix, for byte strings over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], parts: dict[int, tuple[int, int] | None]):
        self.ranks = ranks
        self.made = {pair: rank for rank, pair in parts.items() if pair}
        self.left = {rank: pair[0] for rank, pair in parts.items() if pair}
        self.right = {rank: pair[1] for rank, pair in parts.items() if pair}
        self.never = {rank for rank, pair in parts.items() if pair is None}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._apart: dict[int, bool] = {}

    def apart(self, a: int, b: int) -> bool:
        """Whether the neighbours ``a``, ``b`` stay as they are when their bytes are encoded."""
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 300_000:  # bounded memory
                self._apart.clear()
            known = self._apart[key] = self._stay(a, b)
        return known

    def _stay(self, a: int, b: int) -> bool:
        # undo merges from the latest back; a cross merge that would have come earlier breaks the pair
        limit = float("inf")
        while True:
            if self.made.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                if a in self.right:
                    a = self.right[a]
                    continue
                limit = b + 1
                if b not in self.left:
                    return True
                b = self.left[b]
            else:
                limit = b + 1
                if b in self.left:
                    b = self.left[b]
                    continue
                limit = a
                if a not in self.right:
                    return True
                a = self.right[a]

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """``last`` with an entry for every prefix of ``data``; entries it has are kept."""
        get, never, apart, known, stay = self.ranks.get, self.never, self.apart, self._apart, len(last)
        for end in range(stay + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(data[start:end])
                if token is None or token in never:
                    continue
                if not start:
                    break
                before = last[start - 1]
                ok = known.get(before << 32 | token)
                if ok or ok is None and apart(before, token):
                    break
            last.append(token)
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        return data + more, self.extend(data + more, list(last))

    def replace(self, data: bytes, last: list[int], start: int, end: int, by: bytes) -> tuple[bytes, list[int]]:
        """The table after data[start:end] is replaced: prefixes before ``start`` are kept."""
        new = data[:start] + by + data[end:]
        return new, self.extend(new, last[:start])

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        return self.tokens(data, self.extend(data, []))


def cutter(pattern: str):
    """Pieces of a byte string as the pattern cuts it."""
    import regex

    spelled = pattern.replace(r"(?!\S)", f"(?![^{_SPACES}])").replace(r"[^\s", f"[^{_SPACES}").replace(r"\s", f"[{_SPACES}]")
    find = regex.compile(spelled).findall
    return lambda key: [p.encode() for p in find(key.decode("utf-8", "replace"))]


def piece_encoder(encoder: PrefixEncoder, pattern: str):
    cut = cutter(pattern)

    def encode(keys: list[bytes]) -> list[list[int]]:
        return [encoder.encode(k) if encoders.is_piece(k, []) else [t for p in cut(k) for t in encoder.encode(p)]
                for k in keys]

    return encode


class _Spellings:
    """The bytes of all tokens, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        self.size, self.first = size, np.cumsum(size) - size
        self.text = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each row's bytes begin."""
        size = self.size[ids]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        return self.text[chunks.ragged(self.first[ids], size)], ends[at]


def binary_array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(
        np.ascontiguousarray(data))]).cast(pa.binary())


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit), ``decoded`` (the bytes of those ids) of each row."""
    ranks = read_ranks(rank_file)
    table = docs.sparkSession.sparkContext.broadcast((ranks, halves(ranks)))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = encoders.once(("prefix", rank_file, pattern), lambda: chunks.Remembered(
            piece_encoder(PrefixEncoder(*table.value), pattern)))
        spell = encoders.once(("spell", rank_file), lambda: _Spellings(table.value[0]))
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                ids, at = encoders.row_ids(part.column(1), memory, [])
                text, text_at = spell.decode(ids, at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), binary_array(ids.astype("<u4").view(np.uint8), at * 4), binary_array(text, text_at)],
                    ["doc_id", "ids", "decoded"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
