import json

import numpy as np
import pytest
from fusionlens.operators import ensembles, evaluation, ml, trees
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

CLASSES = 3


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    x = np.stack([rng.integers(0, 40, 500) / 4, rng.normal(size=500).round(1), rng.integers(0, 2, 500), np.full(500, 3.0)], axis=1)
    y = (x[:, 0] > 5).astype(int) + ((x[:, 1] > 0.3) & (rng.random(500) < 0.8))
    return x.astype(float), y.astype(np.uint8)


@pytest.fixture(scope="module")
def frame(spark, sample):
    x, y = sample
    rows = [(i, [float(v) for v in r], float(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(3, "id").withColumn(
        "features", array_to_vector("x")).drop("x")


def plain_boost(codes, label, prior, bins, s):
    """Round by round, node by node, cut by cut."""
    n = codes.shape[1]
    raw = np.repeat(prior[:, None], n, axis=1)
    out = []
    for _ in range(s.rounds):
        p = np.exp(raw - raw.max(axis=0))
        p /= p.sum(axis=0)
        grown = []
        for k in range(len(prior)):
            g = np.rint((p[k] - (label == k)) * trees.UNIT) / trees.UNIT
            h = np.rint(p[k] * (1 - p[k]) * trees.UNIT) / trees.UNIT
            leaves, level = [], [np.arange(n)]
            done = []
            while level:
                found = []
                for rows in level:
                    best = (0.0, None)
                    whole = g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
                    for f in range(len(codes)):
                        for t in range(int(bins.sizes[f]) - 1):
                            a, b = rows[codes[f, rows] <= t], rows[codes[f, rows] > t]
                            if min(len(a), len(b)) < s.min_leaf or min(h[a].sum(), h[b].sum()) < trees.MIN_HESSIAN:
                                continue
                            gain = g[a].sum() ** 2 / (h[a].sum() + s.l2) + g[b].sum() ** 2 / (h[b].sum() + s.l2) - whole
                            if gain > best[0] + 1e-9:
                                best = (gain, (a, b))
                    found.append((best, rows))
                level, room = [], s.leaves - len(done) - len(found)
                for (gain, parts), rows in sorted(found, key=lambda x: -x[0][0]):
                    if parts and room > 0:
                        room -= 1
                        level += parts
                    else:
                        done.append(rows)
            value = np.zeros(n)
            for rows in done:
                value[rows] = -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
            grown.append(value)
        raw += np.stack(grown)
        out.append(raw.copy())
    return out


def test_boosting_equals_a_plain_version(sample):
    x, y = sample
    bins = trees.Bins([np.unique(x[:, f])[:-1] for f in range(4)])
    codes, s = bins.encode(x), trees.BoostSettings(rounds=6, rate=0.3, leaves=6)
    prior = np.log(np.bincount(y) / len(y))
    raw, rounds = np.repeat(prior[:, None], len(y), axis=1), []
    for r, k, tree in trees.boost(codes, y, prior, bins, s):
        raw[k] += tree.value[tree.leaves(codes), 0]
        if k == CLASSES - 1:
            rounds.append(raw.copy())
    np.testing.assert_allclose(rounds, plain_boost(codes, y, prior, bins, s), rtol=1e-9)
    assert (raw.argmax(axis=0) == y).mean() > 0.85


def plain_tree(codes, label, count, key, bins, weight, s, rows=None):
    """The leaf shares of every row, by plain recursion over (node key, rows)."""
    rows = np.arange(len(label)) if rows is None else rows
    whole = np.array([count[rows][label[rows] == c].sum() for c in range(len(weight))])
    best = None
    if len(rows) >= 2 * s.min_leaf and (whole > 0).sum() > 1:
        for j, f in enumerate(trees.draw_order(np.array([key], np.uint64), len(codes))[0]):
            if j >= trees.tried(len(codes)) and best:
                break
            for t in np.unique(codes[f, rows]):
                a, b = rows[codes[f, rows] <= t], rows[codes[f, rows] > t]
                if min(len(a), len(b)) < s.min_leaf:
                    continue
                sums = np.array([count[a][label[a] == c].sum() for c in range(len(weight))], dtype=float)
                score = trees.purity(sums[None, :], whole[None, :], weight)[0]
                if best is None or score > best[0]:
                    best = (score, a, b)
    if best is None:
        share = whole * weight
        return {int(r): tuple((share / share.sum()).astype(np.float32)) for r in rows}
    left, right = trees.child_keys(np.array([key], np.uint64))
    return (plain_tree(codes, label, count, left[0], bins, weight, s, best[1])
            | plain_tree(codes, label, count, right[0], bins, weight, s, best[2]))


def test_a_tree_equals_plain_recursion(sample):
    x, y = sample
    bins = trees.Bins([np.unique(x[:, f])[:-1] for f in range(4)])
    codes, weight = bins.encode(x), np.array([0.5, 1.0, 3.0])
    for number in range(3):
        s = trees.ForestSettings(min_leaf=1 + number)
        count = trees.bootstrap(np.arange(500), number, 42)
        some = np.flatnonzero(count)
        key = trees.root_key(number, 42)
        tree = trees.grow_subtree(codes[:, some], y[some], count[some], key, bins, weight, s)
        got = tree.value[tree.leaves(codes[:, some])]
        want = plain_tree(codes[:, some], y[some], count[some], key, bins, weight, s)
        assert [tuple(r) for r in got] == [want[i] for i in range(len(some))]
    assert abs(trees.bootstrap(np.arange(100_000), 1, 42).mean() - 1) < 0.02


@pytest.mark.parametrize("most", [3, 5_000, 70_000, 3_000_000])
def test_class_counts_side_by_side_equal_counts_one_by_one(most):
    """Many small nodes beside one that holds ``most`` draws: the running sum may wrap around."""
    rng = np.random.default_rng(most)
    n, classes = 3_000, 5
    node, code = np.sort(rng.integers(0, 900, n)), rng.integers(0, 6, n).astype(np.uint8)
    label, count = rng.integers(0, classes, n).astype(np.uint8), rng.integers(1, 4, n)
    count[node == 7] = most // max(1, (node == 7).sum()) + 1
    largest = int(np.bincount(node, weights=count).max())
    sums, rows, owner, value = trees._node_candidates(code, node, label, count, 900, classes, largest)
    want = {}
    for i in np.lexsort((code, node)).tolist():
        same = (node == node[i]) & (code <= code[i])
        want[node[i], code[i]] = ([count[same & (label == c)].sum() for c in range(classes)], same.sum())
    assert list(zip(owner.tolist(), value.tolist())) == [(int(a), int(b)) for a, b in want]
    assert sums.tolist() == [x for x, _ in want.values()] and rows.tolist() == [r for _, r in want.values()]


def _scores(model, frame):
    return {r["id"]: (r["prediction"], [round(p, 12) for p in r["prob_array"]]) for r in model.transform(frame).collect()}


def test_boosting_by_jobs_equals_boosting_in_one_task(frame, monkeypatch):
    monkeypatch.setattr(ensembles, "REFRESH", 2)
    monkeypatch.setattr(ensembles, "SLOTS", 5)
    s = trees.BoostSettings(rounds=3, rate=0.3, leaves=5)
    small = ensembles.TreeEnsemble(s).fit(frame)
    large = ensembles.TreeEnsemble(s, task_bytes=100).fit(frame)
    assert _scores(small, frame) == _scores(large, frame)


def test_boosting_by_jobs_scores_a_tree_once_and_shuffles_a_level_once(spark, frame, monkeypatch):
    plans = []
    real = ensembles._summed_splits

    def watched(hists, *rest):
        plans.append(hists._jdf.queryExecution().executedPlan().toString())
        return real(hists, *rest)

    monkeypatch.setattr(ensembles, "_summed_splits", watched)
    monkeypatch.setattr(ensembles, "REFRESH", 3)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ensembles.TreeEnsemble(trees.BoostSettings(rounds=5, leaves=4), task_bytes=100).fit(frame)
    # every level of every round reads the slopes that were kept, and nothing stays in memory
    assert len(plans) >= 5 and all("InMemoryTableScan" in p for p in plans)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    hists = spark.createDataFrame([(s, b, 1, 2, 3) for s in range(3) for b in range(4)] * 2, ensembles._hist_schema(3))
    seen = []
    kind = type(hists.groupBy("slot"))
    grouped = kind.applyInArrow

    def collected(self, *rest):
        out = grouped(self, *rest)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "applyInArrow", collected)
    got = real(hists, 3, 4, lambda slot, hist: (float(hist[0].sum()), float(hist[2].max())), "slot int, a double, b double")
    assert sorted((r["slot"], r["a"], r["b"]) for r in got) == [(s, 8.0, 6.0) for s in range(3)]
    assert seen[0].count("Exchange") == 1


def test_forest_by_jobs_equals_forest_in_tasks(frame, sample, monkeypatch):
    monkeypatch.setattr(ensembles, "SLOTS", 7)
    s = trees.ForestSettings(trees=5)
    small = ensembles.TreeEnsemble(s).fit(frame)
    want = _scores(small, frame)
    assert np.mean([p == y for (p, _), y in zip((want[i] for i in range(500)), sample[1])]) > 0.85
    assert _scores(ensembles.TreeEnsemble(s, task_bytes=400).fit(frame), frame) == want   # nodes of 100 rows are shipped
    monkeypatch.setattr(ensembles, "GROUP_BYTES", 2000)                                  # trees broadcast in groups
    assert _scores(small, frame) == want
    shallow = trees.ForestSettings(trees=2, max_depth=3)
    assert (_scores(ensembles.TreeEnsemble(shallow, task_bytes=400).fit(frame), frame)
            == _scores(ensembles.TreeEnsemble(shallow).fit(frame), frame))


def test_grid_leaves_artifacts_that_reload_and_nothing_cached(spark, builds_small, tmp_path):
    rows = str(tmp_path / "rows")
    builds_small.dropDuplicates(["Sample_ID"]).where("Sample_ID % 4 = 0").write.parquet(rows)
    df, out = spark.read.parquet(rows), str(tmp_path / "out")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    sizes = {"logistic_regression": {"maxIter": 5}, "random_forest": {"trees": 4}, "hist_gradient_boosting": {"rounds": 3}}
    grid = {(r["scenario"], r["model_type"]): r for r in ml.training_grid(
        df, ["prebuild", "inbuild", "postbuild"], ml.MODEL_TYPES, out, sizes).collect()}
    assert len(grid) == 12 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    for model_type in ml.MODEL_TYPES:
        where = f"scenario=inbuild/model_type={model_type}"
        model, meta = ml.load_model(spark, f"{out}/artifacts/{where}")
        assert meta["scenario"] == "inbuild" and meta["n_rows_train"] + meta["n_rows_test"] == meta["n_rows_total"] > 500
        assert meta["features"][0] == "Alloy_Type" and len(meta["features"]) == 17
        saved = {r["Sample_ID"]: r["prediction"] for r in spark.read.parquet(f"{out}/predictions/{where}").collect()}
        again = model.transform(df.drop("Quality_Class")).select("Sample_ID", ml.predicted_label(meta["labels"]).alias("p"))
        assert {r["Sample_ID"]: r["p"] for r in again.collect() if r["Sample_ID"] in saved} == saved
        doc = json.loads(spark.read.text(f"{out}/metrics/{where}").first()["value"])
        r = grid["inbuild", model_type]
        assert doc["accuracy"] == r["accuracy"] and doc["metadata"]["model_type"] == model_type
        assert sum(map(sum, doc["confusion_matrix"]["matrix"])) == len(saved) and len(doc["classification_report"]) == 4
        assert ml.evaluate_saved(model, meta, df).first()["scenario"] == "inbuild"


def test_metrics_report_is_nested(spark):
    pairs = [("m", "Poor", "Poor")] * 3 + [("m", "Poor", "Good")] + [("m", "Good", "Good")] * 2
    r = evaluation.metrics_report(spark.createDataFrame(pairs, "k string, label string, prediction string"), keys=["k"]).first()
    assert r["confusion_matrix"]["matrix"][0] == [3, 0, 1, 0] and r["classification_report"]["Poor"]["recall"] == 0.75
    assert r["classification_report"]["Moderate"]["support"] == 0 and r["accuracy"] == pytest.approx(5 / 6)


def test_a_split_from_drawn_features_equals_one_from_all(sample):
    x, y = sample
    bins = trees.Bins([np.unique(x[:, f])[:-1] for f in range(4)])
    codes, weight = bins.encode(x), np.array([0.5, 1.0, 3.0])
    for number in range(40):
        count = trees.bootstrap(np.arange(500), number, 42) * (codes[0] < 4 + number)
        at, key = np.flatnonzero(count), trees.root_key(number, 42)
        whole = np.zeros((CLASSES + 1, int(bins.offset[-1])))
        for f in range(4):
            np.add.at(whole, (y[at], bins.offset[f] + codes[f, at]), count[at])
            np.add.at(whole, (CLASSES, bins.offset[f] + codes[f, at]), 1)
        want, order = trees.forest_split(whole, key, bins, weight, 2), trees.draw_order(np.array([key]), 4)
        got = None
        for low, high in ((0, 2), (2, 4)):
            hist = trees.drawn_histogram(codes[:, at], y[at].astype(np.int64), count[at], np.zeros(len(at), np.int64), order[:, low:high], CLASSES)
            got = got or trees.drawn_split(hist[:, 0], order[0, low:high], low, bins, weight, 2)
        assert got[:2] == want[:2] and got[2].tolist() == want[2].tolist()


def test_a_forest_of_few_levels_ships_no_rows(frame, tmp_path):
    rows = frame.select(ensembles.vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"),
                        F.xxhash64("id").alias("key"))
    bins = ensembles.bin_edges(rows, 4)
    table = ensembles.binned(rows, bins, str(tmp_path / "binned"))
    for depth, ships in ((3, False), (None, True)):
        grown = ensembles._tree_batch(table, bins, np.ones(CLASSES), trees.ForestSettings(trees=2, max_depth=depth), 100, range(2))
        assert ("MapInArrow send(" in grown._jdf.queryExecution().executedPlan().toString()) == ships
        assert sorted(r["number"] for r in grown.collect()) == [0, 1]


def test_histograms_of_grouped_features_equal_plain_sums():
    rng = np.random.default_rng(4)
    sizes, n = [2, 256, 9, 1, 50, 2], trees.CHUNK + 700
    bins = trees.Bins([np.arange(s - 1, dtype=float) for s in sizes])
    codes = np.stack([rng.integers(0, s, n).astype(np.uint8) for s in sizes])
    g, h = rng.integers(-trees.UNIT, trees.UNIT + 1, n).astype(float), rng.integers(0, trees.UNIT // 4 + 1, n).astype(float)
    h[:trees.CHUNK] = trees.UNIT // 4  # as large as they get
    groups, joint = trees.joint_codes(codes, bins)
    assert len(joint) == len(groups) < len(sizes) and sorted(f for group in groups for f in group) == list(range(len(sizes)))
    for slots in (1, 5):
        slot = rng.integers(0, slots, n)
        want = np.zeros((3, slots, bins.offset[-1]))
        for f in range(len(sizes)):
            for i, w in enumerate((g, h, np.ones(n))):
                np.add.at(want[i], (slot, bins.offset[f] + codes[f]), w)
        assert np.array_equal(trees.boost_histogram(joint, slot, slots, g, h, bins, groups), want)
        assert np.array_equal(trees.boost_histogram(codes, slot, slots, g, h, bins), want)
