import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest_llm import SF, as_rows
from fusionlens.llm import bit_resample, decontaminate, plane_kmeans, queries
from hypothesis import given, settings
from hypothesis import strategies as st


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- bit_resample ---------------------------------------------------------

def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_resample(rows, target):
    s, t = [0] * 10_000, [0] * 10_000
    for count, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text):
                count[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20 and r[3] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for i, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def test_resample_matches_brute_force(spark, edge_docs, edge_rows, no_docs):
    target = [edge_rows[0][1], "the été 中文字 w1 w2 w3", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = bit_resample.resample(edge_docs, items).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert as_rows(got) == as_rows(brute_resample([r[:2] for r in edge_rows], target))
    assert bit_resample.resample(no_docs, items).count() == 0
    got = bit_resample.resample(edge_docs, items.where("1 = 0")).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert as_rows(got) == as_rows(brute_resample([r[:2] for r in edge_rows], []))


def test_resample_of_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(queries.op11_bit_resample(spark, SF).collect()) == as_rows(brute_resample(rows, target))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("aZ9é中 -", max_size=9) | st.just("x" * 64) | st.just("中" * 30) | st.just("y" * 65), max_size=6)
                .map(" ".join), min_size=1, max_size=5))
def test_feature_buckets(texts):
    raw = [t.encode() for t in texts]
    row, got, n = bit_resample.feature_buckets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    want = [(i, bucket(f)) for i, t in enumerate(texts) for f in features(t)]
    assert sorted(zip(row.tolist(), got.tolist())) == sorted(want)
    assert n.tolist() == [len(words(t)) for t in texts]


def test_bit_planes_sum_exactly():
    rng = np.random.default_rng(5)
    gain = rng.integers(-9000, 9000, bit_resample.BUCKETS)
    row = np.sort(rng.integers(0, 40, 20_000))
    chosen = np.where(rng.random(20_000) < 0.3, 17, rng.integers(0, bit_resample.BUCKETS, 20_000))  # a hot bucket
    got = bit_resample.gain_sums(row, chosen, 41, bit_resample.gain_planes(gain))
    assert got.tolist() == np.bincount(row, weights=gain[chosen], minlength=41).astype(int).tolist()
    for flat in (np.zeros(bit_resample.BUCKETS, np.int64), np.full(bit_resample.BUCKETS, -1), np.full(bit_resample.BUCKETS, 7)):
        got = bit_resample.gain_sums(row, chosen, 41, bit_resample.gain_planes(flat))
        assert got.tolist() == (np.bincount(row, minlength=41) * flat[0]).tolist()


# ---- decontaminate --------------------------------------------------------

def brute_hits(rows, items, width=10):
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + width]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[i:i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= ids
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), ",".join(names)))
    return out


def shown(frame):
    return as_rows((r.doc_id, r.n_words, r.n_hit, len(r["items"]), ",".join(r["items"])) for r in frame.collect())


@pytest.fixture(scope="module")
def edge_items(spark, edge_rows):
    passage, long = edge_rows[0][1], edge_rows[10][1]
    rows = [(1, passage), (2, passage), (10, " ".join(passage.split()[5:25]).upper()), (3, "go go go go"), (4, "Été!"), (5, None),
            (6, ""), (7, "..."), (None, "one line here"), (8, long[:20_000]), (9, "w1 w2"), (9, "中文字")]
    return rows, spark.createDataFrame([(*r, "z") for r in rows], "item_id long, text string, window string")


def test_hits_match_brute_force(edge_docs, edge_rows, edge_items, no_docs):
    rows, items = edge_items
    want = as_rows(brute_hits([r[:2] for r in edge_rows], rows))
    assert shown(decontaminate.hits(edge_docs, items)) == want
    assert shown(decontaminate.hits(edge_docs, items, part_bytes=150_000)) == want  # several parts
    assert decontaminate.hits(no_docs, items).count() == 0
    assert {r.n_hit for r in decontaminate.hits(edge_docs, items.where("1 = 0")).collect()} == {0}


def test_hit_spans_are_the_words_of_the_original(edge_docs, edge_items):
    for r in decontaminate.hits(edge_docs, edge_items[1], keep_text=True).collect():
        all_words = words(r.text)
        assert len(r.spans) == len(r.words)
        for span, run in zip(r.spans, r.words):
            assert words(r.text[span.start:span.end]) == all_words[run.start:run.end]
        assert sum(run.end - run.start for run in r.words) == r.n_hit


def test_hits_of_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = [(d, n, h, k, hashlib.sha256(names.encode()).hexdigest(), h > 0)
            for d, n, h, k, names in brute_hits(rows, [(r.item_id, r.text) for r in bench.collect()])]
    got = queries.op12_decontaminate(spark, SF).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert as_rows(got) == as_rows(want)
    assert any(w[5] for w in want)


# ---- plane_kmeans ---------------------------------------------------------

def brute_kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), n) for n, (i, _) in enumerate(kept) if i is not None)
    centroids = [list(kept[n][1]) for _, n in order[:k]]
    if not centroids:
        return []

    def assign():
        out = []
        for _, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(centroids)):
            own = [x for (_, x), (w, _) in zip(kept, where) if w == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    where = assign()
    return [(i, c, d, sum(y for w, y in where if w == c), sum(y for _, y in where), tuple(centroids[c]))
            for (i, _), (c, d) in zip(kept, where)]


def clusters(frame):
    return as_rows((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in frame.collect())


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).round(4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1])]              # copies, a repeated row
    rows += [(200, None), (201, [1.0] * 63), (202, [1.0] * 65), (203, [None] * 64), (204, [float("nan")] * 64),
             (205, [float("inf")] * 64), (206, []), (None, rows[1][1]), (207, [1000.0, -1000.0] * 32)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "vec_id long, embedding array<double>, cluster int, planes string")
    assert clusters(plane_kmeans.cluster(frame)) == as_rows(brute_kmeans(rows))
    assert clusters(plane_kmeans.cluster(frame.where("vec_id < 3"))) == as_rows(brute_kmeans([r for r in rows if r[0] in (0, 1, 2)]))
    assert plane_kmeans.cluster(frame.where("1 = 0")).collect() == []
    assert plane_kmeans.cluster(frame.where("vec_id = 200")).collect() == []


def test_clusters_of_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = [(*w[:5], hashlib.sha256(",".join(map(str, w[5])).encode()).hexdigest()) for w in brute_kmeans(rows)]
    got = queries.op13_plane_kmeans(spark, SF).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert as_rows(got) == as_rows(want)


def test_too_large_components_are_an_error(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is"):
        plane_kmeans.cluster(frame)


def test_plane_dot_products_are_exact():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-(1 << 26), 1 << 26, (50, 64)), rng.integers(-(1 << 26), 1 << 26, (1, 64))
    got = plane_kmeans.dots(plane_kmeans.to_planes(a, 28), plane_kmeans.to_planes(b, 28))
    assert got.tolist() == (a * b).sum(axis=1).tolist()
    assert plane_kmeans.component_sums(plane_kmeans.to_planes(a, 28)).tolist() == a.sum(axis=0).tolist()
