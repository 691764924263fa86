"""Array helpers for text inside Arrow batches.

A batch is cut into slices of at most ``SLICE_BYTES`` of text (a longer text is
a slice of its own), so that the memory of a task is bounded by the slice and
the longest text, not by the batch or the partition. NULL texts are empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

# ASCII white space that separates words.
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# odd multiplier of the byte polynomial modulo 2**64, and its inverse
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n + n // 4, 1 << 20)
        tables = []
        for r in (_R, _R_INV):
            table = np.full(size, r, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers, _inverse = tables
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row begins."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    at = at.astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words come before each row."""
    inside = _WORD[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)  # a row's border separates words
    edge[at] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes anywhere."""
    up, down = power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(up[:len(buf)] * (buf.astype(np.uint64) + np.uint64(1)), out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes first[i], first[i]+1, ... (lengths[i] of them), one range after another."""
    total = int(lengths.sum())
    shift = first - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ranges that begin at ``a`` and ``b`` hold the same bytes."""
    equal = np.ones(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 16):  # bounded index arrays
        n = lengths[i:i + (1 << 16)]
        differ = buf[ragged(a[i:i + (1 << 16)], n)] != buf[ragged(b[i:i + (1 << 16)], n)]
        if differ.any():
            owner = np.repeat(np.arange(len(n)), n)[differ]
            equal[i + owner] = False
    return equal


_SHORT = 7   # bytes of a range that fit into 64 bits beside their number
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(_SHORT + 1)], dtype=np.uint64)


def _eights(buf: np.ndarray) -> np.ndarray:
    whole = np.zeros((len(buf) >> 3) + 4 << 3, dtype=np.uint8)
    whole[:len(buf)] = buf
    return whole.view("<u8")


def _eight(whole: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 8 bytes from each start on (zeros after the end), as numbers."""
    at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    # a shift by 64 is two shifts
    return whole[at] >> shift | whole[at + 1] << np.uint64(8) << (np.uint64(56) - shift)


def _spelled(whole: np.ndarray, starts: np.ndarray, size: np.ndarray, known: int = 0) -> np.ndarray:
    """The bytes of ranges from the ``known``-th on, at most ``_SHORT``, beside their whole number of bytes."""
    return _eight(whole, starts + known) & _KEPT[size - known] | size.astype(np.uint64) << np.uint64(56)


class _Spellings:
    """A table of short byte strings, each spelled in so many 64-bit words, and a number for each.

    A string is found at the place its words point to or at one of the next; one that finds no place stays out.
    """

    BITS, PROBES = 20, 8
    FREE = np.uint64(0xFF << 56)

    def __init__(self, words: int):
        self.words = [np.full(1 << self.BITS, self.FREE, dtype=np.uint64) for _ in range(words)]
        self.numbers = np.zeros(1 << self.BITS, dtype=np.int32)

    def _place(self, words: list[np.ndarray]) -> np.ndarray:
        h = words[0] if len(words) == 1 else words[0] * np.uint64(_R_INV) ^ words[1]
        return ((h ^ (h >> np.uint64(29))) * np.uint64(_R) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _same(self, at: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
        same = self.words[0][at] == words[0]
        for held, w in zip(self.words[1:], words[1:]):
            same &= held[at] == w
        return same

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """The number of each string, -1 if it is not held."""
        found, rest, at = np.full(len(words[0]), -1, dtype=np.int64), np.arange(len(words[0])), self._place(words)
        for _ in range(self.PROBES):
            same = self._same(at, words)
            found[rest[same]] = self.numbers[at[same]]
            on = np.flatnonzero(~same & (self.words[-1][at] != self.FREE))
            if not len(on):
                break
            rest, at, words = rest[on], at[on] + 1 & (1 << self.BITS) - 1, [w[on] for w in words]
        return found

    def add(self, words: list[np.ndarray], numbers: np.ndarray) -> None:
        """Distinct strings that are not held yet."""
        at = self._place(words)
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.words[-1][at] == self.FREE)
            self.numbers[at[free]] = np.arange(len(free))  # one of those that want a place gets it
            free = free[self.numbers[at[free]] == np.arange(len(free))]
            for held, w in zip(self.words, words):
                held[at[free]] = w[free]
            self.numbers[at[free]] = numbers[free]
            on = np.ones(len(at), dtype=bool)
            on[free] = False
            at, words, numbers = at[on] + 1 & (1 << self.BITS) - 1, [w[on] for w in words], numbers[on]
            if not len(at):
                break


def _names(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each range, and which ranges are long: short ranges are spelled, long ones hashed."""
    names = _spelled(_eights(buf), starts, np.minimum(size, _SHORT))
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        ends = np.cumsum(size[long])
        names[long] = hashes(buf[ragged(starts[long], size[long])], ends - size[long], ends) | np.uint64(1 << 63)
    return names, long


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one range of each content, and for each range its content's number.

    Short ranges are told apart by their bytes, longer ones by a hash and then compared byte by
    byte; should two contents share a hash, the slice is grouped by the bytes themselves.
    """
    size = ends - starts
    names, long = _names(buf, starts, size)
    number = pa.array(names).dictionary_encode().indices.to_numpy()
    chosen = np.zeros(int(number.max()) + 1 if len(number) else 0, dtype=np.int64)
    chosen[number] = np.arange(len(number))
    twin = chosen[number[long]]
    if (size[twin] == size[long]).all() and same_bytes(buf, starts[long], starts[twin], size[long]).all():
        return chosen, number
    raw, seen = buf.tobytes(), {}
    number = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(starts.tolist(), ends.tolist())])
    chosen = np.zeros(len(seen), dtype=np.int64)
    chosen[number] = np.arange(len(number))
    return chosen, number


class Remembered:
    """Results of ``encode`` for byte strings that were seen before.

    ``encode`` takes a list of byte strings and returns a list of id lists, or
    of numbers of ids if ``counts`` is set. At most about ``limit`` strings are
    held: then those used most often stay, and the others are forgotten, or all
    are if they have more than ``limit_bytes``. Results do not depend on it.
    """

    def __init__(self, encode: Callable[[list[bytes]], list], counts: bool = False,
                 limit: int = 400_000, limit_bytes: int = 24_000_000):
        self.encode, self.counts, self.limit, self.limit_bytes = encode, counts, limit, limit_bytes
        self.cleared = 0
        self._clear()

    def _clear(self) -> None:
        self.cleared += 1
        self.tables = _Spellings(1), _Spellings(2)
        self.slot: dict[bytes, int] = {}
        self.first = np.zeros(1024, dtype=np.int64)
        self.size = np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.int32)
        self.uses = np.zeros(1024, dtype=np.int32)
        self.used = self.held = 0

    def _forget(self) -> None:
        """Keep the half of the strings that were used most, if they are short."""
        n = len(self.slot)
        kept = np.argsort(self.uses[:n], kind="stable")[n // 2:] if self.held <= self.limit_bytes else np.zeros(0, np.int64)
        names = np.fromiter(self.slot, dtype=object, count=n)[kept].tolist()
        ids = self.ids[ragged(self.first[kept], self.size[kept])] if not self.counts else self.ids[:0]
        size, uses = self.size[kept], self.uses[kept] // 2
        self._clear()
        self._store(names, size, ids)
        self.uses[:len(kept)] = uses

    def _store(self, names: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.slot)
        for name in ("first", "size", "uses"):
            self._grow(name, n + len(names))
        self._grow("ids", self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.size[n:n + len(names)] = sizes
        self.first[n:n + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.uses[n:n + len(names)] = 0
        self.used += len(ids)
        self.held += sum(map(len, names))
        self.slot.update(zip(names, range(n, n + len(names))))

    def _grow(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if len(old) < n:
            new = np.zeros(max(n, 2 * len(old)), dtype=old.dtype)
            new[:len(old)] = old
            setattr(self, name, new)

    def _places(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.slot.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def look(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First id (in ``self.ids``) and number of ids of each of the distinct keys."""
        at = self._look(keys)
        self.uses[at] += 1
        return self.first[at], self.size[at]

    def _look(self, keys: list[bytes]) -> np.ndarray:
        """Numbers of the distinct keys."""
        at = self._places(keys)
        missing = [keys[i] for i in np.flatnonzero(at < 0).tolist()]
        if self.slot and (len(self.slot) + len(missing) > self.limit or self.held > self.limit_bytes):
            self._forget()
            at = self._places(keys)
            missing = [keys[i] for i in np.flatnonzero(at < 0).tolist()]
        for i in range(0, len(missing), 4096):
            part = missing[i:i + 4096]
            got = self.encode(part)
            sizes = np.fromiter(got if self.counts else map(len, got), np.int64, len(part))
            ids = (self.ids[:0] if self.counts else
                   np.fromiter(itertools.chain.from_iterable(got), np.int32, int(sizes.sum())))
            self._store(part, sizes, ids)
        known = len(self.slot) - len(missing)
        at[at < 0] = np.arange(known, known + len(missing))
        return at

    def of_ranges(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each byte range.

        Ranges of up to 15 bytes that were met before are found by their bytes; the others are looked up once a content.
        """
        size, whole = ends - starts, _eights(buf)
        kinds = [np.flatnonzero(size <= _SHORT), np.flatnonzero((size > _SHORT) & (size <= 8 + _SHORT))]
        words = [[_spelled(whole, starts[kinds[0]], size[kinds[0]])],
                 [_eight(whole, starts[kinds[1]]), _spelled(whole, starts[kinds[1]], size[kinds[1]], 8)]]
        found = np.full(len(starts), -1, dtype=np.int64)
        for kind, w, table in zip(kinds, words, self.tables):
            found[kind] = table.find(w)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            cleared, raw = self.cleared, buf.tobytes()
            numbers, at = self._of_contents(raw, buf, starts, ends, rest)
            if cleared != self.cleared and len(rest) < len(found):  # the numbers found before are void
                rest = np.arange(len(found))
                numbers, at = self._of_contents(raw, buf, starts, ends, rest)
            found[rest] = numbers
            new = np.zeros(len(found), dtype=bool)
            new[at] = True
            for kind, w, table in zip(kinds, words, self.tables):
                some = np.flatnonzero(new[kind])
                table.add([x[some] for x in w], found[kind[some]])
        self.uses[found] += 1  # once a slice
        return self.first[found], self.size[found]

    def _of_contents(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, some: np.ndarray):
        """Numbers of some ranges, and one range of each content."""
        chosen, number = distinct(buf, starts[some], ends[some])
        at = some[chosen]
        return self._look([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])[number], at
