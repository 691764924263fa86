"""Quality classifier: naive Bayes support vectors.

1. A text's features are indicators of n-grams: words and word pairs, and runs
   of one to three word shapes (letter case, marks at the end, same word as
   before, a line that came before), each hashed to one of ``FEATURES``.
2. Over *all* labelled training rows, a feature's ratio is the log of how much
   more often texts of label 1 have it than texts of label 0 (Laplace ``ADD``).
3. The indicators, scaled by the ratios and to unit length, train a linear
   hinge-loss model by dual coordinate descent, on a sample of at most about
   ``FIT_ROWS`` rows (by a hash of the id), in one task. A fifth of that sample
   is kept out to turn margins into probabilities.
4. Every text is scored with the weights, one number per feature: broadcasting
   them is bounded by ``FEATURES``.

Edge cases: a NULL or empty text has no features and scores what the model's
intercept says; rows with a NULL id are never training rows, and are scored;
labels other than 0 and 1, or NULL, are ignored; an id with several label rows
trains once for each; repeated rows score alike. Without training rows of both
classes every text scores the share of label 1 (0.5 without any label). An
empty table gives an empty result. Extra columns are not read unless ``carry``
names them; they return in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import chunks

FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
FIT_ROWS = 6_000
ADD = 1.0
COST = 1.0
ROUNDS = 10
THRESHOLD = 0.7

# classes of a byte in a shape: lower case, upper case, digit, or the byte itself
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[0x80:] = 1


def _runs(codes: np.ndarray, row: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n codes inside each row, and the row of each."""
    size = np.maximum(np.diff(row) - n + 1, 0)
    first = chunks.ragged(row[:-1], size)
    h = np.full(len(first), salt, dtype=np.uint64)
    for k in range(n):
        h = chunks.mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[first + k])
    return h, np.repeat(np.arange(len(size)), size)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, ascending, and where each text's begin."""
    buf, at = chunks.text_bytes(column)
    starts, ends, row = chunks.words(buf, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(row))
    h = chunks.hashes(buf, starts, ends)
    size = ends - starts
    last = ends - 1
    same = np.zeros(len(h), dtype=np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    second = np.where(size > 1, _SHAPE[buf[np.minimum(starts + 1, last)]], 4)
    before = np.where(size > 1, _SHAPE[buf[np.maximum(last - 1, starts)]], 4)
    shape = (((_SHAPE[buf[starts]] * np.uint64(256) + second) * np.uint64(256) + before) * np.uint64(256)
             + _SHAPE[buf[last]]) * np.uint64(2) + same
    found = [_runs(h, row, 1, 1), _runs(h, row, 2, 2),
             *(_runs(shape, row, n, 10 + n) for n in (1, 2, 3)), _line_features(buf, at, starts, ends)]
    keys = np.concatenate([(o.astype(np.uint64) << np.uint64(FEATURE_BITS)) | (x >> np.uint64(64 - FEATURE_BITS))
                           for x, o in found])
    keys = np.sort(keys)
    keys = keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]
    begin = np.searchsorted(keys, np.arange(len(at), dtype=np.uint64) << np.uint64(FEATURE_BITS))
    return (keys & np.uint64(FEATURES - 1)).astype(np.int32), begin


def _line_features(buf: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for a text with a line (with a word) that came before."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.unique(np.concatenate((at, np.flatnonzero(buf == 10) + 1)))
    cut = cut[cut < len(buf)]
    stop = np.append(cut[1:], len(buf))
    stop = stop - (buf[stop - 1] == 10)
    owner = np.searchsorted(at, cut, side="right") - 1
    some = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    line, owner = chunks.hashes(buf, cut[some], stop[some]), owner[some]
    order = np.lexsort((line, owner))
    twice = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    rows = np.unique(owner[order][1:][twice])
    return chunks.mix(np.full(len(rows), 99, dtype=np.uint64)), rows


def log_ratios(with_1: np.ndarray, with_0: np.ndarray, add: float = ADD) -> np.ndarray:
    """Log-count ratios from the numbers of texts of either label that have each feature."""
    p, q = with_1 + add, with_0 + add
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(with_1 == 0) & (with_0 == 0)] = 0
    return ratio


def dual_coordinate_descent(index: np.ndarray, begin: np.ndarray, scale: np.ndarray, label: np.ndarray,
                            cost: float = COST, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model; the last weight is the intercept's.

    Row i has the features index[begin[i]:begin[i+1]], valued scale[feature] and
    scaled to unit length, and a constant 1. Labels are +1 and -1; ``cost`` is
    per row, divided between the classes so that both weigh alike.
    """
    n = len(label)
    w = np.zeros(len(scale) + 1)
    alpha = np.zeros(n)
    share = np.where(label > 0, n / max(1, 2 * (label > 0).sum()), n / max(1, 2 * (label < 0).sum())) * cost
    rows = [unit(index[a:b], scale) for a, b in zip(begin[:-1], begin[1:])]
    square = [1.0 + float(v @ v) for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n).tolist():
            where, value = rows[i]
            slope = label[i] * (float(w[where] @ value) + w[-1]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), share[i])
            step = (new - alpha[i]) * label[i]
            if step:
                alpha[i] = new
                w[where] += step * value
                w[-1] += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def unit(index: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = scale[index]
    norm = float(np.sqrt(value @ value))
    return index, value / norm if norm else value


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities of label 1 (Newton steps, smoothed targets)."""
    up, down = (label > 0).sum(), (label < 0).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin + 1e-6 * a, g.sum()])
        hess = np.array([[s @ margin ** 2 + 1e-6, s @ margin], [s @ margin, s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


@dataclass
class Model:
    """Everything a score needs; arrays of one number per feature."""

    weight: np.ndarray   # model weight times ratio
    square: np.ndarray   # ratio squared, for the unit length
    offset: float
    slope: float
    shift: float

    def scores(self, index: np.ndarray, begin: np.ndarray) -> np.ndarray:
        def total(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate((np.zeros(1), np.cumsum(values[index])))[begin])

        length = np.sqrt(np.maximum(total(self.square), 0))
        margin = total(self.weight) / np.where(length > 1e-9, length, 1.0) + self.offset
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _constant(share: float) -> Model:
    zero = np.zeros(FEATURES)
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(zero, zero, 0.0, 1.0, float(np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, label_col: str, training: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """The model of ``label_col``; ``training`` is a condition on the column ``id`` (default: all labelled rows)."""
    spark = docs.sparkSession
    known = labels.select(labels[label_id_col].alias("id"), labels[label_col].cast("int").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if training is not None:
        known, texts = known.where(training), texts.where(training)
    counted = known.groupBy("label").agg(F.count("*").alias("n")).collect()  # two rows at most
    number = {r["label"]: r["n"] for r in counted}
    if len(number) < 2:
        return _constant(0.5 if not number else float(next(iter(number))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                index, begin = features(part.column(0))
                label = np.repeat(part.column(1).to_numpy(), np.diff(begin))
                for k in (0, 1):
                    total[k] += np.bincount(index[label == k], minlength=FEATURES)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1][some]), pa.array(total[0][some])],
                                         ["feature", "with_1", "with_0"])

    # texts meet labels in one way at every size: labels grow with the texts, so they are never broadcast
    rows = texts.join(known.hint("merge"), "id")
    seen = rows.select("text", "label").mapInArrow(count, "feature long, with_1 long, with_0 long").groupBy("feature").agg(
        F.sum("with_1").alias("with_1"), F.sum("with_0").alias("with_0")).toArrow()  # at most FEATURES rows
    at = seen.column("feature").to_numpy()
    both = np.zeros((2, FEATURES))
    both[1][at], both[0][at] = seen.column("with_1").to_numpy(), seen.column("with_0").to_numpy()
    ratio = spark.sparkContext.broadcast(log_ratios(both[1], both[0]))

    # the bounded sample: about fit_rows rows, those with the smallest 64-bit hashes of the id, and never over twice that
    total = sum(number.values())
    drawn = F.xxhash64("id") <= F.lit(min((1 << 63) - 1, (1 << 64) * fit_rows // total - (1 << 63)))
    sample = texts.where(drawn).join(known.where(drawn).hint("merge"), "id").select(
        "text", "label", F.xxhash64("id", "text").alias("order"), F.xxhash64("id").alias("place")).orderBy("place", "order").limit(
        2 * fit_rows).drop("place").withColumn("all", F.lit(0))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("order").combine_chunks()
        index, begin = [], [np.zeros(1, np.int64)]
        for batch in table.to_batches():
            for part in chunks.slices(batch, "text"):
                i, b = features(part.column(0))
                index.append(i)
                begin.append(b[1:] + begin[-1][-1])
        index, begin = np.concatenate(index), np.concatenate(begin)
        label = np.where(table.column("label").to_numpy() == 1, 1, -1)
        kept_out = np.arange(len(label)) % 5 == 0
        if len(set(label[~kept_out])) < 2 or len(set(label[kept_out])) < 2:
            kept_out[:] = False
        size = np.diff(begin)
        rows = np.flatnonzero(~kept_out)
        weights = dual_coordinate_descent(
            index[chunks.ragged(begin[rows], size[rows])], np.concatenate(([0], np.cumsum(size[rows]))),
            ratio.value, label[rows])
        plain = Model(weights[:-1] * ratio.value, ratio.value ** 2, float(weights[-1]), 1.0, 0.0)
        value = plain.scores(index, begin)
        margin = np.log(value / (1 - value))
        judged = kept_out if kept_out.any() else ~kept_out
        slope, shift = logistic(margin[judged], label[judged])
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "slope": [slope], "shift": [shift]})

    fitted = sample.groupBy("all").applyInArrow(fit, "weights binary, slope double, shift double").collect()
    if not fitted:
        return _constant(number[1] / sum(number.values()))
    weights = np.frombuffer(fitted[0]["weights"])
    return Model(weights[:-1] * ratio.value, ratio.value ** 2, float(weights[-1]), fitted[0]["slope"], fitted[0]["shift"])


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` of each row (and ``text``, ``row``)."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"),
                         *([F.struct(*[docs[c].alias(c) for c in carry]).alias("row")] if carry else []))
    extra = ["text", "row"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                score = table.value.scores(*features(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score), *[part.column(c) for c in extra]], ["doc_id", "score", *extra])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "text" or carry]
    kinds.insert(1, "score double")
    return source.mapInArrow(run, ", ".join(kinds)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
