"""Harmonic packing of token sequences.

Each worker packs its own documents, with no shuffle: lengths are dealt into
reciprocal-capacity classes, class k holding lengths in (C/(k+1), C/k], and a
bin of class k is filled with k documents. A document longer than a bin first
fills bins of its own; what is left of it is dealt by its length. Cutting
closes the gap that a class leaves: a bin takes the head of the next document
of its class, and that document's tail is dealt again by its own length; a
class with too few documents for a bin passes them on to the next class. What
a worker has left in the end, less than one bin, is laid out in sequences whose
lengths are powers of two, so no position is padding.

A worker is a block of about ``BLOCK_TOKENS`` tokens in a task; its memory is
bounded by the block and the longest document. Sequence numbers are the task's
number, the block's and the bin's, so a task that runs again gives the same.

Edge cases: a NULL text is an empty text (its end id alone); NULL ids are
carried through; repeated rows are packed once each; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fusionlens.llm import chunks, encoders

BLOCK_TOKENS = 1 << 21
CLASSES = 64  # lengths up to C/64 share the last class


def plan(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (document, start, length); all but those of the rest are full.

    ``lengths`` are positive. Every id of a document is in exactly one piece.
    """
    bins: list[list[tuple[int, int, int]]] = []
    classes: list[list[tuple[int, int]]] = [[] for _ in range(CLASSES + 1)]
    lengths = lengths.tolist()

    def deal(doc: int, start: int) -> None:
        classes[min(CLASSES, capacity // (lengths[doc] - start))].append((doc, start))

    for doc, n in enumerate(lengths):
        full = n // capacity
        bins += [[(doc, i * capacity, capacity)] for i in range(full)]
        if full * capacity < n:
            deal(doc, full * capacity)
    open_bin: list[tuple[int, int, int]] = []
    room = capacity
    for k in range(1, CLASSES + 1):
        members, i = classes[k], 0
        while i < len(members):  # tails dealt back into this class are seen too
            doc, start = members[i]
            i += 1
            take = min(room, lengths[doc] - start)
            open_bin.append((doc, start, take))
            room -= take
            if not room:
                bins.append(open_bin)
                open_bin, room = [], capacity
                if start + take < lengths[doc]:
                    deal(doc, start + take)
    return bins + _powers_of_two(open_bin, capacity - room)


def _powers_of_two(rest: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The rest in sequences of the sizes of the set bits of its total, largest first."""
    bins: list[list[tuple[int, int, int]]] = []
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    room = 0
    for doc, start, n in rest:
        while n:
            if not room:
                room = sizes[len(bins)]
                bins.append([])
            take = min(n, room)
            bins[-1].append((doc, start, take))
            start, n, room = start + take, n - take, room - take
    return bins


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, byte_level: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit numbers.
    """
    raw = encoders.broadcast_file(docs.sparkSession, vocabulary)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    fields = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoders.special_strings(raw.value)
        memory = encoders.once(("ids", vocabulary), lambda: chunks.Remembered(
            encoders.library_ids(encoders.tokenizer(raw.value), special)))
        task, block = TaskContext.get().partitionId(), 0
        names, parts, sizes, held = [], [], [], 0

        def flush():
            bins = plan(np.concatenate(sizes), capacity)
            everything = np.concatenate(parts).view(np.uint8)
            begin = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
            name = pa.concat_arrays(names)
            doc = np.array([d for b in bins for d, _, _ in b], dtype=np.int64)
            start = np.array([s for b in bins for _, s, _ in b], dtype=np.int64)
            n = np.array([x for b in bins for _, _, x in b], dtype=np.int64)
            count = np.array([len(b) for b in bins], dtype=np.int64)
            number = np.repeat(np.arange(len(bins)), count) + (task * (1 << 20) + block) * (1 << 22)
            into = np.cumsum(n) - n
            into -= np.repeat(into[np.cumsum(count) - count], count)
            first = (begin[doc] + start) * 4
            for i in range(0, len(n), 2048):
                at = slice(i, i + 2048)
                size = n[at] * 4
                data = b"".join(everything[a:a + m].tobytes() for a, m in zip(first[at], size))
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [name.take(pa.array(doc[at])), pa.array(start[at]), pa.array(n[at]),
                     pa.array((begin[doc[at] + 1] - begin[doc[at]])), pa.array(number[at]), pa.array(into[at]), ids],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for part in chunks.slices(batch, "text"):
                ids, at = encoders.row_ids(part.column(1), memory, special, byte_level)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                names.append(part.column(0))
                parts.append(ids)
                sizes.append(np.diff(at) + 1)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield from flush()
                    block, names, parts, sizes, held = block + 1, [], [], [], 0
        if held:
            yield from flush()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {fields}")
