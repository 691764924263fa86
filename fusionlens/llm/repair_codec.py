"""Token ids in files, compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by id; each task encodes its share
and writes shards of about ``SHARD_TOKENS`` ids. A shard is compressed on its
own: in every round its pairs of neighbouring symbols are counted, and the most
frequent pairs that do not overlap become nonterminals, up to ``ROUNDS`` rounds
or until no pair occurs ``MIN_COUNT`` times. End ids are never paired, so a
document's symbols are a range of their own and decode alone; the expansion
length of every symbol finds a position inside a document without decoding
what comes before it.

The files are a Parquet table of shards (``part``, ``shard``, ``n_tokens``,
``doc_ids``, ``grammar``), in ascending order of ids. ``grammar`` is
little-endian: the header ``<4s6I`` (magic, bytes in a symbol, number of ids
in the shard's alphabet, rules, rounds, symbols, documents); 32-bit ids of the
alphabet; 32-bit ends of the rounds in the rules; rules as two symbols each;
32-bit expansion lengths of the rules; the symbols; 32-bit ends of the
documents in the symbols.

Edge cases: a NULL text is an empty text (its end id alone); a NULL id sorts
first; rows that repeat an id follow each other, ordered by text; a hot id is
spread by text over several partitions; an empty table gives an empty table.
Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusionlens.llm import chunks, encoders
from fusionlens.llm.sizing import shares

SHARD_TOKENS = 1 << 20
ROUNDS = 8
MIN_COUNT = 16
SHARE_BYTES = 32 << 20
TABLE = 1 << 24         # cells of the table of a round's pairs; a larger one is searched
_HEADER = struct.Struct("<4s6I")
_MAGIC = b"RPG1"


def compress(ids: np.ndarray, end_id: int, rounds: int = ROUNDS, min_count: int = MIN_COUNT) -> bytes:
    """The grammar of a sequence of documents that each end with ``end_id``, and with it nowhere else."""
    last = ids == end_id
    top = int(ids[~last].max(initial=-1)) + 1  # stands for the end id
    seq = np.where(last, top, ids)
    seen = np.zeros(top + 1, dtype=bool)
    seen[seq] = True
    alphabet = np.flatnonzero(seen)
    small = len(alphabet) < 1 << 15  # then rules have as many numbers at least
    symbol, most = (np.uint16, 1 << 16) if small else (np.uint32, 1 << 31)
    pair, shift = (np.uint32, 16) if small else (np.uint64, 32)
    seq = (np.cumsum(seen) - 1).astype(symbol)[seq]
    end = len(alphabet) - 1 if last.any() else most  # no symbol
    if last.any():
        alphabet[-1] = end_id
    rules, ends = np.zeros((0, 2), dtype=symbol), []
    for _ in range(rounds):
        plain = seq != end
        keys = seq[:-1].astype(pair) << pair(shift) | seq[1:]
        found, count = _counted(keys[plain[:-1] & plain[1:]], min_count)
        chosen = _apart(found, count, shift, most - len(alphabet) - len(rules))
        if not len(chosen):
            break
        chosen = np.sort(chosen)
        at, number = _matches(seq, keys, chosen, shift)
        seq[at] = (len(alphabet) + len(rules) + number).astype(symbol)
        kept = np.ones(len(seq), dtype=bool)
        kept[at + 1] = False
        seq = seq[kept]
        rules = np.concatenate((rules, np.stack((chosen >> pair(shift), chosen & pair((1 << shift) - 1)), 1).astype(symbol)))
        ends.append(len(rules))
    length = _expansion_lengths(len(alphabet), rules, ends)[len(alphabet):]
    docs = np.flatnonzero(seq == end) + 1
    return b"".join((
        _HEADER.pack(_MAGIC, seq.itemsize, len(alphabet), len(rules), len(ends), len(seq), len(docs)),
        alphabet.astype("<u4").tobytes(), np.array(ends, "<u4").tobytes(), rules.astype(f"<u{seq.itemsize}").tobytes(),
        length.astype("<u4").tobytes(), seq.astype(f"<u{seq.itemsize}").tobytes(), docs.astype("<u4").tobytes()))


def _counted(keys: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    often = count >= min_count
    return keys[first[often]], count[often]


def _apart(keys: np.ndarray, count: np.ndarray, shift: int, room: int) -> np.ndarray:
    """The most frequent pairs such that no symbol ends one and begins another."""
    order = np.argsort(-count, kind="stable")
    lefts, rights, chosen = set(), set(), []
    low = (1 << shift) - 1
    for key in keys[order].tolist():
        a, b = key >> shift, key & low
        if a in rights or b in lefts or a == b and (a in lefts or b in rights):
            continue
        lefts.add(a)
        rights.add(b)
        chosen.append(key)
        if len(chosen) >= room:
            break
    return np.array(chosen[:max(room, 0)], dtype=keys.dtype)


def _places(symbols: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Numbers from 1 for these of ``n`` symbols, 0 for all others; how many they are."""
    met = np.zeros(n, dtype=bool)
    met[symbols] = True
    return np.where(met, np.cumsum(met), 0).astype(np.int32), int(met.sum())


def _matches(seq: np.ndarray, keys: np.ndarray, chosen: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions to replace, and the number of the pair at each; ``chosen`` is sorted."""
    left, right = chosen >> chosen.dtype.type(shift), chosen & chosen.dtype.type((1 << shift) - 1)
    row, rows = _places(left, int(seq.max()) + 1)
    column, columns = _places(right, len(row))
    if rows * columns <= TABLE:
        table = np.full((rows + 1) * (columns + 1), -1, dtype=np.int32)  # row and column 0: no pair
        table[row[left] * (columns + 1) + column[right]] = np.arange(len(chosen), dtype=np.int32)
        number = table[(row * np.int32(columns + 1))[seq[:-1]] + column[seq[1:]]]
        at = np.flatnonzero(number >= 0)
        number = number[at].astype(np.int64)
    else:
        at = np.flatnonzero((row > 0)[seq[:-1]] & (column > 0)[seq[1:]])
        number = np.searchsorted(chosen, keys[at])
        ok = number < len(chosen)
        ok[ok] = chosen[number[ok]] == keys[at[ok]]
        at, number = at[ok], number[ok]
    # a run of one symbol overlaps itself: every other pair of it
    new = np.concatenate((np.ones(min(1, len(at)), bool), np.diff(at) != 1))
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    even = (np.arange(len(at)) - start) % 2 == 0
    return at[even], number[even]


def _expansion_lengths(terms: int, rules: np.ndarray, ends: list[int]) -> np.ndarray:
    length = np.ones(terms + len(rules), dtype=np.int64)
    for first, last in zip([0, *ends], ends):
        length[terms + first:terms + last] = length[rules[first:last]].sum(axis=1)
    return length


@dataclass
class Grammar:
    """A shard's grammar, read for decoding."""

    alphabet: np.ndarray
    ends: np.ndarray
    rules: np.ndarray
    length: np.ndarray   # of every symbol's expansion
    seq: np.ndarray
    docs: np.ndarray     # ends of the documents in seq
    _flat: tuple | None = None

    @classmethod
    def read(cls, data: bytes) -> Grammar:
        magic, size, terms, rules, rounds, symbols, docs = _HEADER.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a grammar")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        alphabet, ends = take("<u4", terms), take("<u4", rounds)
        pairs = take(f"<u{size}", 2 * rules).reshape(-1, 2)
        length = np.concatenate((np.ones(terms, np.int64), take("<u4", rules).astype(np.int64)))
        return cls(alphabet, ends, pairs, length, take(f"<u{size}", symbols), take("<u4", docs))

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions, one after another, and where each begins."""
        if self._flat is None:
            first = np.zeros(len(self.length), dtype=np.int64)
            terms = len(self.alphabet)
            first[:terms] = np.arange(terms)
            flat = self.alphabet
            for low, high in zip([0, *self.ends.tolist()], self.ends.tolist()):
                both = self.rules[low:high].ravel()
                new = flat[chunks.ragged(first[both], self.length[both])]
                size = self.length[terms + low:terms + high]
                first[terms + low:terms + high] = len(flat) + np.cumsum(size) - size
                flat = np.concatenate((flat, new))
            self._flat = flat, first
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self._expansions()
        return flat[chunks.ragged(first[symbols], self.length[symbols])]

    def document(self, i: int) -> np.ndarray:
        """All ids of document ``i``, from its own symbols alone."""
        return self.expand(self.seq[self.docs[i - 1] if i else 0:self.docs[i]])

    def ids(self, i: int, start: int, n: int) -> np.ndarray:
        """``n`` ids of document ``i`` from ``start`` on; only the symbols that cover them are expanded."""
        symbols = self.seq[self.docs[i - 1] if i else 0:self.docs[i]]
        ends = np.cumsum(self.length[symbols])
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, start + n, side="left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(symbols[a:b])[skip:skip + n]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and where each begins."""
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.length[self.seq])))
        return self.expand(self.seq), ends[np.concatenate((np.zeros(1, np.int64), self.docs.astype(np.int64)))]


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, byte_level: bool = True,
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their ids, in ascending order of the document id, to ``path``.

    Inside a grammar documents end with a number that no vocabulary has, so
    ``end_id`` may also be an id of a text.
    """
    raw = encoders.broadcast_file(docs.sparkSession, vocabulary)
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    dealt = source.repartitionByRange(
        shares(source, "text", SHARE_BYTES), F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = encoders.special_strings(raw.value)
        memory = encoders.once(("ids", vocabulary), lambda: chunks.Remembered(
            encoders.library_ids(encoders.tokenizer(raw.value), special)))
        part, shard = TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            listed = pa.concat_arrays(names)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                 pa.array([compress(ids, _END)], pa.binary())],
                ["part", "shard", "n_tokens", "doc_ids", "grammar"])

        for batch in batches:
            for rows in chunks.slices(batch, "text"):
                ids, at = encoders.row_ids(rows.column(1), memory, special, byte_level)
                names.append(rows.column(0))
                parts.append(np.insert(ids.astype(np.int64), at[1:], _END))
                held += len(parts[-1])
                if held >= SHARD_TOKENS:
                    yield flush()
                    shard, names, parts, held = shard + 1, [], [], 0
        if held:
            yield flush()

    kind = source.schema["doc_id"].dataType.simpleString()
    dealt.mapInArrow(run, f"part int, shard int, n_tokens long, doc_ids array<{kind}>, grammar binary").withColumn(
        "end_id", F.lit(end_id)).write.option("compression", "zstd").parquet(path)


#: The end of a document inside a grammar: no vocabulary has this id, so an end id inside a text stays apart.
_END = (1 << 32) - 1


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``part``, ``shard``, ``start`` (in the shard), ``n_tokens``, ``ids`` of each written document."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                grammar = Grammar.read(batch.column("grammar")[row].as_py())
                ids, at = grammar.documents()
                ids = ids.copy()
                ids[at[1:] - 1] = batch.column("end_id")[row].as_py()
                names = batch.column("doc_ids")[row].values
                n = len(names)
                first = 0
                while first < n:  # some MB at a time
                    last = max(first + 1, int(np.searchsorted(at, at[first] + (1 << 19), side="right")) - 1)
                    here = at[first:last + 1]
                    data = ids[here[0]:here[-1]].astype("<u4").tobytes()
                    offsets = ((here - here[0]) * 4).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [names[first:last], pa.array([batch.column("part")[row].as_py()] * (last - first), pa.int32()),
                         pa.array([batch.column("shard")[row].as_py()] * (last - first), pa.int32()),
                         pa.array(here[:-1]), pa.array(np.diff(here)),
                         pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(data)])],
                        ["doc_id", "part", "shard", "start", "n_tokens", "ids"])
                    first = last

    return files.select("part", "shard", "doc_ids", "grammar", "end_id").mapInArrow(
        run, f"doc_id {kind}, part int, shard int, start long, n_tokens long, ids binary")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part``, ``shard``, ``before``: ids in all shards before each; one short row per shard."""
    shards = spark.read.parquet(path).select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return shards.withColumn("inside", inside).join(parts, "part").select(
        "part", "shard", (F.col("earlier") + F.col("inside")).alias("before"))
