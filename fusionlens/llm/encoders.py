"""Exact token ids of whole texts from the ids of their chunks.

A text is cut where the tokenizer's own pre-tokenization always cuts, so the
ids of a text are the ids of its pieces one after another; pieces repeat, texts
do not. Runs of ASCII and Latin-1 letters, digits and marks are cut here; a run
with any other character, an apostrophe or a special string stays whole and is
left to the library. Vocabulary files are read on the driver and broadcast (their size is
the file's, under 2 MB here); executors need no local copy.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from fusionlens.llm import chunks

#: Bytes that begin white space other than ASCII, or are control characters that some patterns call white space.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# White space beyond ASCII, in UTF-8.
_WIDE_SPACES = {c.encode() for c in (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")}


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_loaded: dict = {}


def once(key: tuple, make):
    """``make()``, kept for this worker process; one entry of each kind."""
    kind = key[0]
    if kind not in _loaded or _loaded[kind][0] != key:
        _loaded[kind] = (key, make())
    return _loaded[kind][1]


def tokenizer(raw: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())


def special_strings(raw: bytes) -> list[bytes]:
    return [t["content"].encode() for t in json.loads(raw)["added_tokens"]]


def strings(keys: list[bytes]) -> list[str]:
    return [k.decode("utf-8", "replace") for k in keys]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SPELL = {b: c for b, c in byte_letters().items() if chr(b) != c}
_SPACE = _SPELL[32]
#: A piece that was cut here: no apostrophe, control separators or characters beyond Latin-1 letters and signs.
_SIMPLE = re.compile(rb"(?:[\x00-\x1b\x20-\x26\x28-\x7f]|\xc3[\x80-\xbf])*")


def spelled(key: bytes) -> str:
    """The bytes in the letters of a byte-level vocabulary."""
    return key.decode("latin-1").translate(_SPELL)


def is_piece(key: bytes, special: list[bytes]) -> bool:
    """Whether the key is one pre-token; if not, it is a whole run for the library."""
    return _SIMPLE.fullmatch(key) is not None and not (b"<" in key and any(s in key for s in special))


def library_ids(tok, special: list[bytes]):
    """Ids by the library: merges alone for a pre-token, everything else with all its steps and defaults."""
    merge = tok.model.tokenize

    def encode(keys: list[bytes]) -> list[list[int]]:
        out, rest = [], []
        for k in keys:
            if k.isalpha():  # ASCII letters spell themselves
                out.append([t.id for t in merge(k.decode())])
            elif k[1:].isalpha() and k[0] == 32:
                out.append([t.id for t in merge(_SPACE + k[1:].decode())])
            elif is_piece(k, special):
                out.append([t.id for t in merge(spelled(k))])
            else:
                rest.append(len(out))
                out.append(None)
        whole = tok.encode_batch_fast(strings([keys[i] for i in rest]), add_special_tokens=False)
        for i, e in zip(rest, whole):
            out[i] = e.ids
        return out

    return encode


# Classes of bytes inside a run: 1 letter, 2 digit, 3 mark; _OTHER bytes keep their run whole.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_OTHER = np.zeros(256, dtype=bool)
_OTHER[[0x1C, 0x1D, 0x1E, 0x1F, 0x27, 0xC2, *range(0xC4, 0x100)]] = True


def _cut_runs(buf: np.ndarray, begin: np.ndarray, ends: np.ndarray, whole: list[bytes], joined: np.ndarray,
              single_digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs cut where letters, digits and marks meet; ``joined`` runs begin with their space."""
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    sign = np.where((buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7), 3, 1)  # the two signs among the letters
    kind[lead], kind[lead + 1] = sign, sign
    other = _OTHER[buf]
    at = _find(buf, whole)
    other[at] = True
    found = np.flatnonzero(other)
    run = np.searchsorted(begin, found, side="right") - 1
    kept = np.ones(len(begin), dtype=bool)  # runs that may be cut
    found, run = found[run >= 0], run[run >= 0]
    kept[run[found < ends[run]]] = False
    inner = np.zeros(len(buf), dtype=bool)
    inner[1:] = kind[1:] != kind[:-1]
    if single_digits:
        inner[1:] |= kind[1:] == 2
    inner[begin] = False
    inner[begin[joined] + 1] = False
    inside = np.zeros(len(buf) + 1, dtype=np.int8)
    inside[begin[kept]] += 1
    inside[ends[kept]] -= 1
    cut = np.flatnonzero(inner & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    return (np.insert(begin, np.searchsorted(begin, cut), cut), np.insert(ends, np.searchsorted(ends, cut), cut))


def _find(buf: np.ndarray, strings: list[bytes]) -> np.ndarray:
    found, raw = [], buf.tobytes() if strings else b""
    for s in strings:
        i = raw.find(s)
        while i >= 0:
            found.append(i)
            i = raw.find(s, i + 1)
    return np.array(sorted(found), dtype=np.int64)


def _odd_rows(buf: np.ndarray, at: np.ndarray, whole: list[bytes]) -> np.ndarray:
    """Rows with white space beyond ASCII, or with one of the strings ``whole``."""
    found = _find(buf, whole)
    lead = np.flatnonzero(_LEADS[buf])
    if len(lead):
        raw = buf.tobytes()
        wide = [i for i in lead.tolist() if raw[i:i + 1] in _WIDE_SPACES or raw[i:i + 2] in _WIDE_SPACES
                or raw[i:i + 3] in _WIDE_SPACES]
        found = np.concatenate((found, np.array(wide, dtype=np.int64)))
    return np.unique(np.searchsorted(at, found, side="right") - 1)


def byte_level_pieces(buf: np.ndarray, at: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, and how many pieces come before each row.

    The pattern joins one space to the word after it; of the white space before
    that, or before a word without a space, the last character stands alone and
    what comes before is one piece; white space that ends a text is one piece.
    A row with other white space or a special string is one piece.
    """
    starts, ends, row = chunks.words(buf, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(row))
    gap = np.maximum(np.concatenate((np.zeros(1, np.int64), ends[:-1]))[:len(ends)], at[owner])
    joined = (starts > gap) & (buf[np.maximum(starts - 1, 0)] == 0x20)
    begin = starts - joined
    cut = np.where(joined, begin, np.maximum(gap, starts - 1))
    last = np.maximum(np.concatenate((np.zeros(1, np.int64), ends))[row[1:]], at[:-1])  # end of each row's last word
    s = np.concatenate((gap, cut, last))
    e = np.concatenate((cut, begin, at[1:]))
    odd = _odd_rows(buf, at, whole)
    extra = np.flatnonzero(e > s)
    s, e = s[extra], e[extra]
    if len(odd):
        inside = np.isin(np.searchsorted(at, s, side="right") - 1, odd)
        s, e = np.concatenate((s[~inside], at[odd])), np.concatenate((e[~inside], at[odd + 1]))
        plain = ~np.isin(owner, odd)
        begin, ends, joined = begin[plain], ends[plain], joined[plain]
    begin, ends = _cut_runs(buf, begin, ends, [], joined, single_digits=False)
    order = np.argsort(s, kind="stable")
    place = np.searchsorted(begin, s[order])
    begin, ends = np.insert(begin, place, s[order]), np.insert(ends, place, e[order])
    return begin, ends, np.searchsorted(begin, at)


def word_pieces(buf: np.ndarray, at: np.ndarray, whole: list[bytes]) -> tuple[np.ndarray, ...]:
    """The bytes with simple letters in lower case; starts and ends of the pieces, and how many before each row.

    For a vocabulary that drops white space, folds case and takes digits one by one.
    """
    starts, ends, row = chunks.words(buf, at)
    lower = buf + (((buf >= 65) & (buf <= 90)) * np.uint8(32)).astype(np.uint8)
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    upper = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] <= 0x9E) & (buf[lead + 1] != 0x97)]
    lower[upper + 1] += 32
    special = _find(buf, whole)
    if len(special):  # these match as they are written: their runs keep their case
        runs = np.unique(np.searchsorted(starts, special, side="right") - 1)
        same = chunks.ragged(starts[runs], ends[runs] - starts[runs])
        lower[same] = buf[same]
    begin, ends = _cut_runs(lower, starts, ends, whole, np.zeros(len(starts), dtype=bool), single_digits=True)
    return lower, begin, ends, np.searchsorted(begin, at)


def row_ids(column: pa.Array, memory: chunks.Remembered, special: list[bytes],
            byte_level: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a column, and where each row's ids begin."""
    buf, at = chunks.text_bytes(column)
    if byte_level:
        starts, ends, row = byte_level_pieces(buf, at, special)
    else:
        buf, starts, ends, row = word_pieces(buf, at, special)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    first, size = memory.of_ranges(buf, starts, ends)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    return memory.ids[chunks.ragged(first, size)], before[row]
