"""The naive Bayes support vectors against a plain version: counts, ratios, descent, scores."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from fusionlens.llm import nb_svm
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    out = []
    for i in range(300):
        label = int(rng.random() < 0.6)
        words = [rng.choice((good if label else bad) if rng.random() < 0.5 else good + bad) for _ in range(rng.randint(1, 25))]
        out.append((i, " ".join(words), label))
    return out + [(300, None, 1), (301, "", 0)]


def plain_features(text):
    return set(nb_svm.features(pa.array([text or ""]))[0].tolist())


def plain_model(ordered, ratio):
    """(weights, intercept) by dual coordinate descent over dicts."""
    labels = [1 if y else -1 for _, y in ordered]
    share = {s: len(labels) / max(1, 2 * labels.count(s)) for s in (1, -1)}
    vectors = []
    for found, _ in ordered:
        norm = math.sqrt(sum(ratio[f] ** 2 for f in found))
        vectors.append({f: ratio[f] / norm if norm else 0.0 for f in found})
    w, b, alpha = {}, 0.0, [0.0] * len(labels)
    rng = np.random.default_rng(0)
    for _ in range(nb_svm.ROUNDS):
        moved = 0.0
        for i in rng.permutation(len(labels)).tolist():
            y, v = labels[i], vectors[i]
            slope = y * (sum(w.get(f, 0.0) * x for f, x in v.items()) + b) - 1
            new = min(max(alpha[i] - slope / (1 + sum(x * x for x in v.values())), 0.0), share[y])
            step, alpha[i] = (new - alpha[i]) * y, new
            for f, x in v.items():
                w[f] = w.get(f, 0.0) + step * x
            b += step
            moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def test_model_and_scores_equal_a_plain_version(spark, rows):
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = nb_svm.train(docs, labels, "quality", training=F.col("id") % 4 != 2)
    known = [(i, plain_features(t), y) for i, t, y in rows if i % 4 != 2]

    count = {y: {} for y in (0, 1)}
    for _, found, y in known:
        for f in found:
            count[y][f] = count[y].get(f, 0) + 1
    whole = {y: sum(count[y].values()) + nb_svm.ADD * nb_svm.FEATURES for y in (0, 1)}
    ratio = {f: math.log((count[1].get(f, 0) + 1) / whole[1]) - math.log((count[0].get(f, 0) + 1) / whole[0])
             for f in set(count[0]) | set(count[1])}
    got = {f: math.sqrt(model.square[f]) for f in np.flatnonzero(model.square).tolist()}
    assert {f: pytest.approx(abs(r)) for f, r in ratio.items() if abs(r) > 1e-12} == got

    order = {r["id"]: r["o"] for r in docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("o")).collect()}
    known.sort(key=lambda r: order[r[0]])
    w, b = plain_model([(f, y) for n, (_, f, y) in enumerate(known) if n % 5], ratio)
    assert model.offset == pytest.approx(b)
    weights = {f: x * ratio[f] for f, x in w.items() if abs(x * ratio[f]) > 1e-12}
    assert {f: pytest.approx(x) for f, x in weights.items()} == {
        f: model.weight[f] for f in np.flatnonzero(np.abs(model.weight) > 1e-12).tolist()}

    scored = {r["doc_id"]: (r["score"], r["predicted"]) for r in nb_svm.classify(docs, model).collect()}
    right = 0
    for i, text, y in rows:
        found = plain_features(text)
        norm = math.sqrt(sum(ratio.get(f, 0.0) ** 2 for f in found))
        margin = sum(w.get(f, 0.0) * ratio.get(f, 0.0) for f in found) / (norm if norm > 1e-9 else 1.0) + b
        want = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        assert scored[i] == (pytest.approx(want), int(scored[i][0] >= 0.7))
        right += (scored[i][0] >= 0.5) == bool(y)
    assert right > 270


def test_a_bounded_sample_is_the_smallest_hashes(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    a, b = (nb_svm.train(docs.repartition(n), labels, "quality", fit_rows=60) for n in (2, 7))
    assert np.array_equal(a.weight, b.weight) and a.offset == b.offset
    whole = nb_svm.train(docs, labels, "quality")
    assert not np.array_equal(a.weight, whole.weight) and np.array_equal(a.square, whole.square)
    assert nb_svm.train(docs, labels, "quality", fit_rows=1).weight.any() in (True, False)  # one row or none: no crash
