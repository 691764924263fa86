"""Boosted trees and random forests as Spark ML estimators, fitted on features binned once.

``TreeEnsemble.fit`` turns the feature vectors into 8-bit codes, packed in blocks of
rows, written once to the shared folder. How trees grow from there depends only on
the size of that table, and gives the same trees either way, because every
split is decided by sums of integers (``trees``):

* a table, or a node of a forest, of at most ``task_bytes`` of codes is finished
  where it is whole: trees of a forest are dealt to tasks, the rounds of a boosting run need no
  round trips. What is broadcast or shipped is bounded by ``task_bytes``;
* larger ones are grown by jobs: each task adds its rows to histograms of all
  open nodes, a ``groupBy`` sums them, one task a node finds the best split, and
  the driver only sees one row a node. Boosting keeps the rows' scores and slopes of the
  current round (in memory, on disk where it does not suffice), so a level does not score the trees before
  it again, and writes the scores every ``REFRESH`` rounds; a forest ships a node's rows to one task as soon
  as they are few enough, so its depth has no limit.

A fitted model is a table of trees, one row each; scoring broadcasts it in groups of
``GROUP_BYTES`` and adds up votes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionlens.operators import trees as T
from fusionlens.session import shared_path

BLOCK_ROWS = 1 << 16
TASK_BYTES = 32 << 20    # of codes that one task may hold whole (a million rows of 32 features)
GROUP_BYTES = 96 << 20   # of trees that are broadcast at once
REFRESH = 10             # boosting by jobs: rounds between two writes of the scores
SLOTS = 96               # nodes whose histograms one job collects
HIST_FEATURES = 2560     # of a forest: nodes times drawn features of one job
HIST_LEVELS = 8          # so many last levels of a forest with a depth limit are grown by jobs alone
MORE = -2                # no drawn feature splits the node: it looks at the others
TREE_BATCH = 16          # trees of a forest grown by jobs at once
BLOCK = "n int, codes binary, label binary, keys binary"
STATE = "n int, codes binary, label binary, raw binary, slope binary"  # slope: gradients, then hessians, by class
TREE = "number int, class int, feature binary, threshold binary, left binary, value binary"


def _tree_row(number: int, cls: int, tree: T.Tree) -> tuple:
    return number, cls, tree.feature.tobytes(), tree.threshold.tobytes(), tree.left.tobytes(), tree.value.tobytes()


def _tree(row: dict, width: int, kind) -> T.Tree:
    return T.Tree(np.frombuffer(row["feature"], np.int16), np.frombuffer(row["threshold"], np.uint8),
                  np.frombuffer(row["left"], np.int32), np.frombuffer(row["value"], kind).reshape(-1, width))


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                                      [n for n, _ in fields])


# ---------------------------------------------------------------------------
# binning
# ---------------------------------------------------------------------------

def bin_edges(rows: DataFrame, width: int, bins: int = 255) -> T.Bins:
    """Edges from approximate quantiles of every feature: one aggregate, ``width`` short lists to the driver."""
    probabilities = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    columns = [F.get("x", F.lit(i)) for i in range(width)]
    found = rows.agg(*[F.percentile_approx(c, probabilities, F.lit(20_000)).alias(f"q{i}") for i, c in enumerate(columns)],
                     *[F.min(c).alias(f"a{i}") for i, c in enumerate(columns)],
                     *[F.max(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    edges = []
    for i in range(width):
        e = np.unique(np.array([found[f"a{i}"] or 0.0, *(found[f"q{i}"] or [])], dtype=np.float64))
        edges.append(e[e < found[f"b{i}"]] if found[f"b{i}"] is not None else e[:0])
    return T.Bins(edges)


def binned(rows: DataFrame, bins: T.Bins, path: str) -> DataFrame:
    """Blocks of rows, written to ``path``: ``n``, ``codes`` (feature by feature), ``label``, ``keys`` (64 bits a row)."""
    fields = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, keys, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return _batch([(size, np.concatenate(held, axis=1).tobytes(), np.concatenate(labels).tobytes(),
                            np.concatenate(keys).tobytes())], fields)

        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held.append(bins.encode(x))
            labels.append(batch.column(1).to_numpy().astype(np.uint8))
            keys.append(batch.column(2).to_numpy())
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield flush()
                held, labels, keys, size = [], [], [], 0
        if size:
            yield flush()

    rows.select("x", "label", "key").mapInArrow(run, fields).write.parquet(path)
    return rows.sparkSession.read.schema(fields).parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            row["codes"] = np.frombuffer(row["codes"], np.uint8).reshape(-1, row["n"])
            for name, kind in (("label", np.uint8), ("keys", np.int64)):
                if name in row:
                    row[name] = np.frombuffer(row[name], kind)
            yield row


def _whole(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, labels and keys of a table that is known to be small."""
    blocks = list(_blocks(table.toArrow().to_batches()))
    return (np.ascontiguousarray(np.concatenate([b["codes"] for b in blocks], axis=1)), np.concatenate([b["label"] for b in blocks]),
            np.concatenate([b["keys"] for b in blocks]))


def _summed_splits(hists: DataFrame, channels: int, width: int, best, out: str) -> list[dict]:
    """Histogram rows (slot, bin, c0, c1, ...) summed over tasks; ``best(slot, (channels, bins))`` in one task a slot.

    A task has each cell once, so the rows are dealt by slot at once, without a shuffle for the sums before it.
    """
    summed = hists.repartition("slot").groupBy("slot", "bin").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(channels)])

    def choose(group: pa.Table) -> pa.Table:
        slot, hist = group.column("slot")[0].as_py(), np.zeros((channels, width))
        at = group.column("bin").to_numpy()
        for i in range(channels):
            hist[i, at] = group.column(f"c{i}").to_numpy()
        return pa.Table.from_batches([_batch([(slot, *best(slot, hist))], out)])

    return [r.asDict() for r in summed.groupBy("slot").applyInArrow(choose, out).collect()]


def _hist_rows(hist: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of (channels, slots, bins) that hold rows."""
    slot, at = np.nonzero(hist[-1])
    for i in range(0, len(slot), 1 << 16):
        s, b = slot[i:i + (1 << 16)], at[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(s.astype(np.int32)), pa.array(b.astype(np.int32)), *[pa.array(c[s, b].astype(np.int64)) for c in hist]],
            ["slot", "bin", *[f"c{j}" for j in range(len(hist))]])


def _hist_schema(channels: int) -> str:
    return "slot int, bin int, " + ", ".join(f"c{i} long" for i in range(channels))


# ---------------------------------------------------------------------------
# boosting
# ---------------------------------------------------------------------------

def _boost_in_task(table: DataFrame, bins: T.Bins, prior: np.ndarray, s: T.BoostSettings, path: str) -> None:
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(_whole(table))  # at most task_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, label, _ = sent.value
                for r, k, tree in T.boost(codes, label, prior, bins, s):
                    yield _batch([_tree_row(r * len(prior) + k, k, tree)], TREE)

    spark.range(1, numPartitions=1).mapInArrow(run, TREE).write.parquet(path)
    sent.unpersist()


def _boost_by_jobs(table: DataFrame, bins: T.Bins, prior: np.ndarray, s: T.BoostSettings, path: str) -> None:
    spark, classes, width = table.sparkSession, len(prior), int(bins.offset[-1])
    rows = []

    def advanced(state: DataFrame, grown: list[T.Tree]) -> DataFrame:
        """The rows with the scores after these trees, and the slopes that the next ones are grown from."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                raw = (np.repeat(prior[:, None], block["n"], axis=1) if block["raw"] is None
                       else np.frombuffer(block["raw"], np.float64).reshape(classes, -1).copy())
                for k, tree in enumerate(grown):
                    raw[k] += tree.value[tree.leaves(block["codes"]), 0]
                slope = np.stack(T.softmax_gradients(raw, block["label"])).astype(np.int32)  # at most UNIT
                yield _batch([(block["n"], block["codes"].tobytes(), block["label"].tobytes(), raw.tobytes(), slope.tobytes())], STATE)

        return state.select("n", "codes", "label", "raw").mapInArrow(run, STATE)

    state, before = advanced(table.withColumn("raw", F.lit(None).cast("binary")), []).persist(), None
    for r in range(s.rounds):
        def splits_of(growing, frontier):
            found = {}
            for i in range(0, len(frontier), SLOTS):
                some = frontier[i:i + SLOTS]

                def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    hist = np.zeros((3, len(some), width))
                    for block in _blocks(batches):
                        g, h = np.frombuffer(block["slope"], np.int32).reshape(2, classes, -1).astype(np.float64)
                        for k in range(classes):
                            slot_of = np.full(len(growing[k].feature), -1)
                            for slot, (c, node) in enumerate(some):
                                if c == k:
                                    slot_of[node] = slot
                            slot = slot_of[growing[k].nodes(block["codes"])]
                            at = np.flatnonzero(slot >= 0)
                            hist += T.boost_histogram(block["codes"].take(at, axis=1), slot[at], len(some), g[k][at], h[k][at], bins)
                    yield from _hist_rows(hist)

                def best(slot, hist):
                    gain, feature, threshold, left, whole = T.boost_splits(hist[:, None, :], bins, s)[0]
                    return (gain, feature, threshold, *left.tolist(), *whole.tolist())

                out = "slot int, gain double, feature int, threshold int, " + ", ".join(f"{x}{j} double" for x in "lw" for j in range(3))
                for x in _summed_splits(state.select("n", "codes", "slope").mapInArrow(run, _hist_schema(3)), 3, width, best, out):
                    found[i + x["slot"]] = (x["gain"], x["feature"], x["threshold"], np.array([x[f"l{j}"] for j in range(3)]),
                                            np.array([x[f"w{j}"] for j in range(3)]))
            return [found[i] for i in range(len(frontier))]

        grown = T.grow_boosted(classes, splits_of, s)
        rows += [_tree_row(r * classes + k, k, tree) for k, tree in enumerate(grown)]
        if before is not None:
            before.unpersist()
        before = state
        if r + 1 == s.rounds:
            break
        state = advanced(state, grown)
        if (r + 1) % REFRESH == 0:  # written, so that the lineage ends here
            folder = shared_path(spark, "boosting-scores")
            state.drop("slope").write.parquet(folder)
            state = advanced(spark.read.schema(state.drop("slope").schema).parquet(folder), [])
        state = state.persist()
    state.unpersist()
    spark.createDataFrame(rows, TREE).coalesce(1).write.parquet(path)  # rounds x classes trees of at most 31 leaves


# ---------------------------------------------------------------------------
# forest
# ---------------------------------------------------------------------------

def _forest_in_tasks(table: DataFrame, bins: T.Bins, weight: np.ndarray, s: T.ForestSettings, path: str) -> None:
    """Every tree in one task; the table is broadcast (at most task_bytes)."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(_whole(table))
    tasks = min(s.trees, 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, label, keys = sent.value
        for batch in batches:
            for number in batch.column(0).to_pylist():
                count = T.bootstrap(keys, number, s.seed)
                some = np.flatnonzero(count)
                tree = T.grow_subtree(codes[:, some], label[some], count[some], T.root_key(number, s.seed), bins, weight, s)
                yield _batch([_tree_row(number, -1, tree)], TREE)

    spark.range(0, s.trees, numPartitions=tasks).mapInArrow(run, TREE).write.parquet(path)
    sent.unpersist()


def _forest_by_jobs(table: DataFrame, bins: T.Bins, weight: np.ndarray, s: T.ForestSettings, task_rows: int, path: str) -> None:
    for a in range(0, s.trees, TREE_BATCH):
        _tree_batch(table, bins, weight, s, task_rows, range(a, min(s.trees, a + TREE_BATCH))).write.mode("append").parquet(path)


def _tree_batch(table: DataFrame, bins: T.Bins, weight: np.ndarray, s: T.ForestSettings, task_rows: int, numbers: range) -> DataFrame:
    """Top levels by summed histograms, then every node of at most ``task_rows`` rows in a task of its own."""
    spark, classes = table.sparkSession, len(weight)
    growing = {t: T.Growing() for t in numbers}
    facts = {(t, 0): (T.root_key(t, s.seed), 0) for t in numbers}  # key and depth of a node
    counts: dict[tuple[int, int], np.ndarray] = {}                 # class counts and rows of a node
    frontier, ship = [(t, 0) for t in numbers], set()

    def shipped(depth: int) -> bool:
        """A few more levels by histograms move less than the rows do."""
        return s.max_depth is None or s.max_depth - depth > HIST_LEVELS

    while frontier:
        found, order = {}, dict(zip(frontier, T.draw_order(np.array([facts[x][0] for x in frontier], np.uint64), len(bins.sizes))))
        # a node looks at its first features, then, if none of them can be split, at the others
        for low, high in ((0, T.tried(len(bins.sizes))), (T.tried(len(bins.sizes)), len(bins.sizes))):
            left_over = [x for x in frontier if low == 0 or x in found and found[x]["feature"] == MORE]
            slots = max(1, HIST_FEATURES // max(1, high - low))
            for i in range(0, len(left_over), slots):
                some = left_over[i:i + slots]
                drawn = np.stack([order[x][low:high] for x in some])
                trees_of = {t: [slot for slot, x in enumerate(some) if x[0] == t] for t in sorted({t for t, _ in some})}

                def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                    hist = np.zeros((classes + 1, len(some), high - low, 256))
                    for block in _blocks(batches):
                        for t, mine in trees_of.items():
                            slot_of = np.full(len(growing[t].feature), -1)
                            slot_of[[some[slot][1] for slot in mine]] = np.arange(len(mine))
                            count = T.bootstrap(block["keys"], t, s.seed)
                            slot = np.where(count > 0, slot_of[growing[t].nodes(block["codes"])], -1)
                            at = np.flatnonzero(slot >= 0)
                            hist[:, mine] += T.drawn_histogram(block["codes"][:, at], block["label"][at].astype(np.int64), count[at],
                                                               slot[at], drawn[mine], classes)
                    yield from _hist_rows(hist.reshape(classes + 1, len(some), -1))

                def best(slot, hist):
                    hist = hist.reshape(classes + 1, high - low, 256)
                    whole = hist[:, 0].sum(axis=1)
                    got = None
                    if T.splittable(whole[:-1], whole[-1], s.min_leaf):
                        got = T.drawn_split(hist, drawn[slot], low, bins, weight, s.min_leaf) or (
                            MORE if high < len(bins.sizes) else -1, 0, np.zeros(classes + 1))
                    feature, threshold, left = got or (-1, 0, np.zeros(classes + 1))
                    return (feature, threshold, *left.tolist(), *whole.tolist())

                out = "slot int, feature int, threshold int, " + ", ".join(f"{x}{j} double" for x in "lw" for j in range(classes + 1))
                for x in _summed_splits(table.mapInArrow(run, _hist_schema(classes + 1)), classes + 1, (high - low) * 256, best, out):
                    found[some[x["slot"]]] = x
        following = []
        for t, node in frontier:
            x = found.get((t, node))
            if x is None:  # no row was drawn for this tree
                counts[t, node] = np.zeros(classes + 1)
                continue
            key, depth = facts[t, node]
            whole = np.array([x[f"w{j}"] for j in range(classes + 1)])
            counts[t, node] = whole
            if node == 0 and whole[-1] <= task_rows and shipped(depth):
                ship.add((t, node))
                continue
            if x["feature"] < 0 or (s.max_depth is not None and depth >= s.max_depth):
                continue
            left = np.array([x[f"l{j}"] for j in range(classes + 1)])
            keys = T.child_keys(np.array([key], dtype=np.uint64))
            for child, k, c in zip(growing[t].split(node, x["feature"], x["threshold"]), keys, (left, whole - left)):
                facts[t, child], counts[t, child] = (k[0], depth + 1), c
                if c[-1] <= task_rows and shipped(depth + 1):
                    ship.add((t, child))
                elif (s.max_depth is None or depth + 1 < s.max_depth) and T.splittable(c[:-1], c[-1], s.min_leaf):
                    following.append((t, child))
        frontier = following
    tops = {}
    for t in numbers:
        values = {n: T.leaf_shares(counts[t, n][None, :-1], weight)[0] for n in range(len(growing[t].feature))}
        tops[t] = growing[t].finished(values, classes)
        tops[t].value = tops[t].value.astype(np.float32)
    fields = "tree int, node int, n int, codes binary, label binary, count binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for t in numbers:
                count = T.bootstrap(block["keys"], t, s.seed)
                node = np.where(count > 0, growing[t].nodes(block["codes"]), -1)
                order = np.argsort(node, kind="stable")
                names, begin = np.unique(node[order], return_index=True)
                for name, at in zip(names.tolist(), np.split(order, begin[1:])):
                    if (t, name) in ship:
                        yield _batch([(t, name, len(at), np.ascontiguousarray(block["codes"][:, at]).tobytes(),
                                       block["label"][at].tobytes(), count[at].tobytes())], fields)

    def finish(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        t, node = rows[0]["tree"], rows[0]["node"]
        codes = np.concatenate([np.frombuffer(r["codes"], np.uint8).reshape(-1, r["n"]) for r in rows], axis=1)
        label = np.concatenate([np.frombuffer(r["label"], np.uint8) for r in rows])
        count = np.concatenate([np.frombuffer(r["count"], np.int64) for r in rows])
        key, depth = facts[t, node]
        part = T.grow_subtree(codes, label, count, key, bins, weight, s, depth)
        return pa.Table.from_batches([_batch([_tree_row(t, node, part)], TREE)])

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        t = rows[0]["number"]
        parts = {r["class"]: _tree(r, classes, np.float32) for r in rows if r["class"] >= 0}
        return pa.Table.from_batches([_batch([_tree_row(t, -1, T.grafted(tops[t], parts))], TREE)])

    empty = spark.createDataFrame([(t, -1, b"", b"", b"", b"") for t in numbers], TREE)  # a tree may have no part
    if not ship:
        return empty.groupBy("number").applyInArrow(join, TREE)
    parts = table.mapInArrow(send, fields).groupBy("tree", "node").applyInArrow(finish, TREE)
    return parts.unionByName(empty).groupBy("number").applyInArrow(join, TREE)


# ---------------------------------------------------------------------------
# Spark ML
# ---------------------------------------------------------------------------

class TreeEnsemble(Estimator):
    """Fits ``settings`` (``BoostSettings`` or ``ForestSettings``) on the columns ``features`` and ``label``.

    A forest weighs classes by 1 / their share; boosting does not weigh rows. A
    forest's draws depend on the rows themselves (a hash of ``id_col``, if the
    table has it, and the features), not on how they are stored.
    """

    def __init__(self, settings: T.BoostSettings | T.ForestSettings, task_bytes: int = TASK_BYTES, id_col: str = "Sample_ID"):
        super().__init__()
        self.settings, self.task_bytes, self.id_col = settings, task_bytes, id_col

    def _fit(self, dataset: DataFrame) -> TreeEnsembleModel:
        spark = dataset.sparkSession
        x = vector_to_array("features")
        named = [F.col(self.id_col).cast("string")] if self.id_col in dataset.columns else []
        rows = dataset.select(x.alias("x"), F.col("label").cast("int").alias("label"), F.xxhash64(*named, x).alias("key"))
        counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
        number = np.array([counted.get(k, 0) for k in range(max(counted) + 1)], dtype=np.float64)
        width = len(rows.first()["x"])
        bins = bin_edges(rows, width)
        table = binned(rows, bins, shared_path(spark, "binned"))
        total, path = int(number.sum()), shared_path(spark, "trees")
        prior = np.log(np.maximum(number, 1e-9) / total)
        in_task = total * width <= self.task_bytes
        if isinstance(self.settings, T.BoostSettings):
            (_boost_in_task if in_task else _boost_by_jobs)(table, bins, prior, self.settings, path)
        else:
            weight = total / (len(number) * np.maximum(number, 1e-9))
            if in_task:
                _forest_in_tasks(table, bins, weight, self.settings, path)
            else:
                _forest_by_jobs(table, bins, weight, self.settings, max(1, self.task_bytes // width), path)
        return TreeEnsembleModel(bins.edges, prior, isinstance(self.settings, T.BoostSettings), path)


class TreeEnsembleModel(Model, MLWritable, MLReadable):
    """Adds ``prob_array`` and ``prediction``; vector columns are dropped on the way."""

    def __init__(self, edges: list[np.ndarray], prior: np.ndarray, boosted: bool, path: str):
        super().__init__()
        self.edges, self.prior, self.boosted, self.path = edges, prior, boosted, path

    def trees(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(TREE).parquet(self.path)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, bins, classes, boosted = dataset.sparkSession, T.Bins(self.edges), len(self.prior), self.boosted
        trees = self.trees(spark)
        facts = trees.agg(F.sum(F.octet_length("feature") * 7 / 2 + F.octet_length("value")).alias("size"), F.count(F.lit(1)).alias("n")).first()
        groups = max(1, -(-int(facts["size"] or 0) // GROUP_BYTES))
        prior, number = self.prior, max(1, facts["n"])
        kept = [f.name for f in dataset.schema if not isinstance(f.dataType, VectorUDT) and f.name not in ("prob_array", "prediction")]
        work = dataset.select(F.struct(*kept).alias("__row"), vector_to_array("features").alias("__x"),
                              F.lit(None).cast("array<double>").alias("__votes"))
        schema = work.schema
        for g in range(groups):
            if g:  # one group of trees in memory at a time
                state = shared_path(spark, "votes")
                work.write.parquet(state)
                work = spark.read.schema(schema).parquet(state)
            some = trees.where(F.col("number") % groups == g).toArrow().sort_by("number").to_pylist()
            sent = spark.sparkContext.broadcast([
                (r["class"], _tree(r, 1 if boosted else classes, np.float64 if boosted else np.float32)) for r in some])

            def run(batches: Iterator[pa.RecordBatch], sent=sent, last=g + 1 == groups) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    n = batch.num_rows
                    codes = bins.encode(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)) if n else np.zeros((0, 0))
                    votes = np.zeros((n, classes))
                    if batch.column(2).null_count < n:
                        votes += batch.column(2).flatten().to_numpy().reshape(n, classes)
                    for k, tree in sent.value if n else ():
                        got = tree.value[tree.leaves(codes)]
                        if boosted:
                            votes[:, k] += got[:, 0]
                        else:
                            votes += got
                    if last and boosted:
                        votes = np.exp(votes + prior - (votes + prior).max(axis=1, keepdims=True, initial=-np.inf))
                        votes /= votes.sum(axis=1, keepdims=True)
                    elif last:
                        votes /= number
                    ends = np.arange(n + 1, dtype=np.int32) * classes
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.ravel()))],
                        ["__row", "__x", "__votes"])

            work = work.mapInArrow(run, schema)
        best = F.array_position("__votes", F.array_max("__votes")) - 1
        return work.select("__row.*", F.col("__votes").alias("prob_array"), best.cast("double").alias("prediction"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, instance: TreeEnsembleModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        facts = {"edges": [e.tolist() for e in m.edges], "prior": m.prior.tolist(), "boosted": m.boosted}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"ensemble": json.dumps(facts)})
        m.trees(self.sparkSession).write.parquet(f"{path}/trees")


class _ModelReader(MLReader):
    def load(self, path: str) -> TreeEnsembleModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        facts = json.loads(metadata["ensemble"])
        model = TreeEnsembleModel([np.array(e, dtype=np.float64) for e in facts["edges"]], np.array(facts["prior"]),
                                  facts["boosted"], f"{path}/trees")
        model._resetUid(metadata["uid"])
        return model
