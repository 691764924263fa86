"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Every text becomes a 64-bit fingerprint: the bitwise majority of the XXH64
   hashes of its word shingles, repeats included.
2. Distinct fingerprints are indexed. Two fingerprints that differ in at most
   ``max_bits`` bits agree on at least one of ``max_bits + 1`` bit blocks, so a
   row for each block and its value gathers all that can link. That shared
   block is the root pattern of a tree: the members are sorted by the Gray rank
   of their bits (the block first, so neighbours share long bit patterns), cut
   into leaves, and each node keeps the mask of the bits on which all its
   members agree, and those bits. Two nodes whose agreed bits differ in more
   than ``max_bits`` places are pruned as whole groups, level by level; the
   differences of what is left are counted exactly.
3. A tree hands on at most one link for each member (a spanning forest), so a
   large group of near copies never becomes all its pairs.
4. A root with more members than ``LEAF_ROWS`` is spread: its Gray-sorted runs
   are the rows, pairs of runs are pruned by their patterns before any
   fingerprints are paired, and each surviving pair of runs is a task of its
   own.
5. Components grow by joins on the links (alternating stars); each round
   is written to the shared folder, and nothing but counts reaches the driver.

Edge cases: a NULL text is an empty text; no words give fingerprint zero, which
links like any other; fewer words than a shingle give one shingle of them all;
repeated rows give repeated results; rows with a NULL id take part and get the
component's smallest id (NULL if it has none). An empty table gives an empty
result. Extra columns never clash: only id and text are read, unless ``carry``
names more, which return in the struct ``row`` of ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import chunks
from fusionlens.llm.sizing import shuffle_width, staged

BITS = 64
LEAF = 32           # fingerprints below a lowest node
LEAF_ROWS = 8192    # fingerprints of a root that one task takes at once
_LANES = np.uint64(0x0001000100010001)


def _majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each range at[i]:at[i+1] of hashes, the bits set in over half of them."""
    n = np.diff(at)
    out = np.zeros(len(n), dtype=np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # four 16-bit counters in a word: cut long ranges, so that none overflows
    step = 1 << 15
    pieces = -(-n[some] // step)
    owner = np.repeat(np.arange(len(some)), pieces)
    first = np.repeat(at[:-1][some], pieces) + chunks.ragged(np.zeros(len(some), np.int64), pieces) * step
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    half = n[some]
    found = np.zeros(len(some), dtype=np.uint64)
    for k in range(16):  # bits k, k+16, k+32, k+48
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, first)
        for j in range(4):
            count = np.add.reduceat(((lanes >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.int64), new)
            found |= (2 * count > half).astype(np.uint64) << np.uint64(k + 16 * j)
    out[some] = found
    return out


def fingerprints_of(column: pa.Array, width: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    buf, at = chunks.text_bytes(column)
    low = buf + (((buf >= 65) & (buf <= 90)) * np.uint8(32)).astype(np.uint8)
    starts, ends, row = chunks.words(low, at)
    size = ends - starts
    # words with one space after each, one after another
    joined = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    first = np.cumsum(size + 1) - (size + 1)
    joined[chunks.ragged(first, size)] = low[chunks.ragged(starts, size)]
    n_words = np.diff(row)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    a = chunks.ragged(row[:-1], n_shingles)
    b = a + np.repeat(np.minimum(n_words, width) - 1, n_shingles)
    raw = joined.tobytes()
    h = np.fromiter((digest(raw[s:e], 42) for s, e in zip(first[a].tolist(), (first + size)[b].tolist())),
                    np.uint64, len(a))
    return _majority(h, np.concatenate(([0], np.cumsum(n_shingles))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                 carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of each row."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                         *([F.struct(*[docs[c].alias(c) for c in carry]).alias("row")] if carry else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                fp = fingerprints_of(part.column(1), width).view(np.int64)
                kept = [part.column(0), *([part.column(2)] if carry else []), pa.array(fp)]
                yield pa.RecordBatch.from_arrays(kept, names=["doc_id", *(["row"] if carry else []), "fp"])

    kinds = [f"doc_id {source.schema['doc_id'].dataType.simpleString()}",
             *([f"row {source.schema['row'].dataType.simpleString()}"] if carry else []), "fp long"]
    return source.mapInArrow(run, ", ".join(kinds))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the max_bits + 1 blocks."""
    n = max_bits + 1
    return [(i * BITS // n, (i + 1) * BITS // n - i * BITS // n) for i in range(n)]


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    out = bits.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _patterns(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits on which the codes at[i]:at[i+1] agree, and those bits."""
    ones = np.bitwise_and.reduceat(codes, at)
    mask = ones | ~np.bitwise_or.reduceat(codes, at)
    return mask, ones & mask


class _Forest:
    """Components of a task's members as an array of labels."""

    def __init__(self, labels: np.ndarray):
        self.up = labels.tolist()
        self.labels = labels.copy()

    def _find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
        """Join the pairs; the pairs that were apart before."""
        apart = self.labels[x] != self.labels[y]
        if not apart.any():
            return [], []
        src, dst = [], []
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            p, q = self._find(i), self._find(j)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                src.append(i)
                dst.append(j)
        up = np.array(self.up)
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        self.labels = up
        return src, dst


def _tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the root down: (starts, masks, bits); a node has up to 8 children."""
    at = np.arange(0, len(codes), LEAF)
    levels = []
    while True:
        levels.append((np.append(at, len(codes)), *_patterns(codes, at)))
        if len(at) == 1:
            return levels[::-1]
        at = at[::8]


def _leaf_pairs(left: np.ndarray, right: np.ndarray, most: int, same: bool, agree: np.uint64):
    """Pairs of lowest nodes that no pattern prunes, in blocks.

    Walks both trees from their roots: a pair of nodes whose agreed bits differ
    in more than ``most`` places, or at all on the shared block ``agree``, is
    dropped with everything below it.
    """
    levels_a, levels_b = _tree(left), _tree(right)
    depth = max(len(levels_a), len(levels_b))
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    stack = [(0, a, b)]
    while stack:
        level, a, b = stack.pop()
        la, lb = levels_a[min(level, len(levels_a) - 1)], levels_b[min(level, len(levels_b) - 1)]
        differ = (la[2][a] ^ lb[2][b]) & la[1][a] & lb[1][b]
        ok = (np.bitwise_count(differ) <= most) & (differ & agree == 0)
        if same:
            ok &= a <= b
        a, b = a[ok], b[ok]
        if level == depth - 1:
            for i in range(0, len(a), 256):
                yield la[0], lb[0], a[i:i + 256], b[i:i + 256]
            continue
        na, nb = levels_a[min(level + 1, len(levels_a) - 1)], levels_b[min(level + 1, len(levels_b) - 1)]
        for i in range(0, len(a), 4096):  # bounded memory
            stack.append((level + 1, *_children(a[i:i + 4096], b[i:i + 4096], la, na, lb, nb)))


def _children(a, b, la, na, lb, nb):
    def span(x, level, lower):
        if level is lower:
            return x, np.ones(len(x), np.int64)
        return x * 8, np.minimum(x * 8 + 8, len(lower[0]) - 1) - x * 8

    (fa, ca), (fb, cb) = span(a, la, na), span(b, lb, nb)
    k, wide = chunks.ragged(np.zeros(len(a), np.int64), ca * cb), np.repeat(cb, ca * cb)
    return np.repeat(fa, ca * cb) + k // wide, np.repeat(fb, ca * cb) + k % wide


def _join_near(left: np.ndarray, right: np.ndarray | None, most: int, agree: np.uint64,
               labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that join what is near (fewer than members), and the labels then.

    Pairs of nodes that lie in one component already are not compared again.
    """
    same = right is None
    right, shift = (left, 0) if same else (right, len(left))
    every = left if same else np.concatenate([left, right])
    forest, src, dst = _Forest(labels), [], []

    def span(at, n, shift):
        x = chunks.ragged(at[n], at[n + 1] - at[n]) + shift
        first = np.cumsum(at[n + 1] - at[n]) - (at[n + 1] - at[n])
        seen = forest.labels[x]
        return np.minimum.reduceat(seen, first), np.maximum.reduceat(seen, first)

    for at_a, at_b, a, b in _leaf_pairs(left, right, most, same, agree):
        (low_a, high_a), (low_b, high_b) = span(at_a, a, 0), span(at_b, b, shift)
        todo = (np.minimum(low_a, low_b) != np.maximum(high_a, high_b))
        a, b = a[todo], b[todo]
        na, nb = at_a[a + 1] - at_a[a], at_b[b + 1] - at_b[b]
        k, wide = chunks.ragged(np.zeros(len(a), np.int64), na * nb), np.repeat(nb, na * nb)
        x, y = np.repeat(at_a[a], na * nb) + k // wide, np.repeat(at_b[b], na * nb) + k % wide
        ok = np.bitwise_count(left[x] ^ right[y]) <= most
        i, j = forest.join(x[ok], y[ok] + shift)
        src += i
        dst += j
    return every[np.array(src, dtype=np.int64)], every[np.array(dst, dtype=np.int64)], forest.labels


_RUN = ("block int, share long, a long, b long, run int, mask long, bits long, codes binary, labels binary")


def _run_rows(block: int, share: int, a: np.ndarray, b: np.ndarray,
              cut: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    n, none = len(a) + len(cut), [None] * len(a)
    pattern = [_patterns(codes, np.zeros(1, np.int64)) for codes, _ in cut]
    after = [None] * len(cut)
    one = lambda x: int(x.view(np.int64)[0])
    return pa.table({
        "block": pa.array([block] * n, pa.int32()), "share": pa.array([share] * n, pa.int64()),
        "a": pa.array(a.view(np.int64).tolist() + after, pa.int64()),
        "b": pa.array(b.view(np.int64).tolist() + after, pa.int64()),
        "run": pa.array(none + list(range(len(cut))), pa.int32()),
        "mask": pa.array(none + [one(m) for m, _ in pattern], pa.int64()),
        "bits": pa.array(none + [one(x) for _, x in pattern], pa.int64()),
        "codes": pa.array(none + [codes.tobytes() for codes, _ in cut], pa.binary()),
        "labels": pa.array(none + [x.astype(np.int32).tobytes() for _, x in cut], pa.binary()),
    })


def links(distinct_fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """``a``, ``b``: links of distinct fingerprints (column ``fp``) that keep every component whole."""
    spark = distinct_fps.sparkSession
    blocks = _blocks(max_bits)
    # a root for each block and share of its values: about half a run of members
    wide = max(1, min(1 << min(bits for _, bits in blocks), -(-distinct_fps.count() // (LEAF_ROWS // 2))))
    keys = F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.pmod(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1)), F.lit(wide)).alias("share"))
        for i, (low, bits) in enumerate(blocks)]))
    rows = distinct_fps.select("fp", keys.alias("k")).select("k.block", "k.share", "fp")

    def shared(block: int) -> np.uint64:
        low, bits = blocks[block]
        return np.uint64(((1 << bits) - 1) << low)

    def index(table: pa.Table) -> pa.Table:
        """Gray-sort a root's members and join them; its runs are handed on if there are many."""
        block, share = table.column("block")[0].as_py(), table.column("share")[0].as_py()
        codes = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        low, bits = blocks[block]
        turn = np.uint64((BITS - low - bits) % BITS)  # the shared block leads
        turned = (codes << turn) | (codes >> np.uint64(BITS - int(turn))) if turn else codes
        codes = codes[np.argsort(gray_rank(turned), kind="stable")]
        src, dst, cut = [], [], []
        for i in range(0, len(codes), LEAF_ROWS):
            run = codes[i:i + LEAF_ROWS]
            a, b, labels = _join_near(run, None, max_bits, shared(block), np.arange(len(run)))
            src.append(a)
            dst.append(b)
            cut.append((run, labels))
        return _run_rows(block, share, np.concatenate(src), np.concatenate(dst), cut if len(cut) > 1 else [])

    found = staged(rows.groupBy("block", "share").applyInArrow(index, _RUN), "gray-index")
    direct = found.where("run IS NULL").select("a", "b")
    many = found.where("run IS NOT NULL")
    if many.isEmpty():
        return direct
    side = many.select("block", "share", "run", "mask", "bits")
    agree = F.element_at(F.array(*[F.lit(int(shared(i).view(np.int64))) for i in range(len(blocks))]), F.col("block") + 1)
    pairs = side.alias("x").join(side.alias("y"), ["block", "share"]).where("x.run < y.run").select(
        "block", "share", F.col("x.run").alias("run"), F.col("y.run").alias("other"),
        F.expr("(x.bits ^ y.bits) & x.mask & y.mask").alias("differ"))
    pairs = pairs.where((F.bit_count("differ") <= max_bits) & (F.col("differ").bitwiseAND(agree) == 0)).drop("differ")
    body = many.select("block", "share", "run", F.struct("codes", "labels").alias("mine"))
    pairs = pairs.join(body, ["block", "share", "run"]).join(
        body.select("block", "share", F.col("run").alias("other"), F.col("mine").alias("theirs")),
        ["block", "share", "other"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, mine, theirs = (batch.column(c)[row].as_py() for c in ("block", "mine", "theirs"))
                x, y = (np.frombuffer(m["codes"], np.uint64) for m in (mine, theirs))
                own, far = (np.frombuffer(m["labels"], np.int32).astype(np.int64) for m in (mine, theirs))
                a, b, _ = _join_near(x, y, max_bits, shared(block), np.concatenate([own, far + len(x)]))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    spread = pairs.select("block", "run", "other", "mine", "theirs").repartition(
        shuffle_width(spark), "block", "run", "other")
    return direct.unionByName(spread.mapInArrow(compare, "a long, b long"))


def components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` of every node on a link: the smallest node it can reach.

    Alternating stars: each node hangs its larger neighbours on its smallest
    one, then each node hangs its smaller neighbours on the smallest; both keep
    components whole and halve paths, until the links are stars.
    """
    def large(edges: DataFrame) -> DataFrame:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()

    def small(edges: DataFrame) -> DataFrame:  # a > b on every link
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        joined = edges.join(low, "a")
        return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            joined.select("a", F.col("low").alias("b"))).where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    last = mark(edges)
    for _ in range(most_rounds):
        if not last[0]:
            break
        edges = staged(small(large(edges)), "links")
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(printed: DataFrame, max_bits: int) -> DataFrame:
    """``fp``, ``root``, ``component_id`` of each distinct fingerprint of ``printed`` (``doc_id``, ``fp``)."""
    nodes = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    stars = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(stars, nodes.fp == stars.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id``, ``root`` of each row.

    ``root`` names the component by its smallest fingerprint.
    """
    printed = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return printed.join(_grouped(printed, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4,
                carry: list[str] | None = None) -> DataFrame:
    """One row of each component, that of the smallest id: ``doc_id`` and ``row`` (the columns ``carry``).

    Of rows that repeat an id and a fingerprint, any one stays. Only ids and
    fingerprints are grouped; the carried columns are joined to the chosen.
    """
    printed = staged(fingerprints(docs, id_col, text_col, width, carry or [id_col]), "fingerprints")
    pairs = printed.groupBy("doc_id", "fp").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "copies")
    chosen = pairs.join(_grouped(printed.select("doc_id", "fp"), max_bits).select("fp", "root"), "fp").groupBy(
        "root").agg(F.min(first).alias("c")).select(
        F.col("c.doc_id").alias("chosen_id"), F.col("c.fp").alias("chosen_fp"), "c.copies")
    kept = printed.join(chosen, (printed.fp == chosen.chosen_fp) & printed.doc_id.eqNullSafe(chosen.chosen_id))
    single = kept.where("copies = 1").select("doc_id", "row")
    return single.unionByName(kept.where("copies > 1").dropDuplicates(["doc_id", "fp"]).select("doc_id", "row"))
