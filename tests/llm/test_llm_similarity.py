import re

import duckdb
import numpy as np
import pytest
import xxhash
from conftest_llm import as_rows
from fusionlens.llm import gray_simhash, hamming_topk, nb_svm, queries
from pyspark.sql import functions as F


def brute_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, most):
    up = list(range(len(codes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i] ^ codes[i + 1:]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def expected(rows):
    codes = np.array([brute_fingerprint(t) for _, t in rows], dtype=np.uint64)
    roots = brute_components(codes, 4)
    low = {}
    for (doc_id, _), root in zip(rows, roots):
        low[root] = min((x for x in (low.get(root), doc_id) if x is not None), default=None)
    return [(d, f"{int(c):016x}", low[root]) for (d, _), c, root in zip(rows, codes, roots)], roots


def test_near_duplicates_match_brute_force(edge_docs, edge_rows, documents, no_docs):
    got = gray_simhash.near_duplicates(edge_docs).select("doc_id", "fingerprint", "component_id").collect()
    assert as_rows(got) == as_rows(expected([r[:2] for r in edge_rows])[0])
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = gray_simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id").collect()
    assert as_rows(got) == as_rows(expected(rows)[0])
    assert gray_simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_component(edge_docs, edge_rows):
    got = gray_simhash.one_of_each(edge_docs, carry=["doc_id", "text"]).collect()
    want, roots = expected([r[:2] for r in edge_rows])
    assert len(got) == len(set(roots))
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({w[2] for w in want if w[2] is not None})


def test_gray_rank_orders_the_gray_sequence():
    i = np.arange(1 << 12, dtype=np.uint64)
    assert (gray_simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


@pytest.mark.parametrize("leaf_rows", [8192, 256])
def test_links_of_clustered_codes(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(gray_simhash, "LEAF_ROWS", leaf_rows)
    rng = np.random.default_rng(3)
    codes = []
    for base in rng.integers(0, 2 ** 63, 6, dtype=np.uint64):
        for _ in range(300):
            x = int(base)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            codes.append(x)
    codes = np.unique(np.concatenate([np.array(codes, np.uint64), rng.integers(0, 2 ** 63, 500, dtype=np.uint64)]))
    found = gray_simhash.components(gray_simhash.links(spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    signed = codes.view(np.int64).tolist()
    groups = {}
    for i, r in enumerate(brute_components(codes, 4)):
        groups.setdefault(r, []).append(signed[i])
    for members in groups.values():
        assert {root.get(m, m) for m in members} == {min(members)}


def test_top_k_matches_sql(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist(), "x", 1) for i in range(300)]
    rows += [(300 + i, rows[i % 7][1], "x", 1) for i in range(60)]          # copies
    rows += [(400, rows[0][1][:20], "x", 1), (None, rows[1][1], "x", 1), (401, None, "x", 1), (0, rows[0][1], "x", 1),
             (402, [float("nan")] + rows[2][1][1:], "x", 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string, query long")
    got = hamming_topk.top_k(vectors, 10, F.col("id") % 20 == 0)
    con = duckdb.connect()
    con.register("embeddings", vectors.select("vec_id", "embedding").toArrow())
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({hamming_topk.oracle()})").fetchall()
    assert as_rows(got.collect()) == as_rows(want)
    assert hamming_topk.top_k(vectors.where("1 = 0")).count() == 0
    assert hamming_topk.top_k(vectors.where("vec_id < 4"), 10).groupBy("query_id").count().agg(F.max("count")).first()[0] == 3


def test_top_k_over_many_shards_salts_and_query_blocks(spark, monkeypatch):
    for name, size in (("PREFIX_ROWS", 16), ("SHARD_ROWS", 20), ("QUERY_ROWS", 50)):
        monkeypatch.setattr(hamming_topk, name, size)
    rng = np.random.default_rng(8)
    hot = rng.normal(size=64)
    rows = [(i, np.concatenate([hot[:24], rng.normal(size=40)]).tolist()) for i in range(150)]  # one value of a segment
    rows += [(150 + i, rng.normal(size=64).tolist()) for i in range(250)]
    rows += [(400 + i, (hot * np.where(rng.random(64) < 0.03, -1, 1)).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes = {i: sum(1 << b for b, x in enumerate(v) if x > 0) for i, v in rows}
    got = {}
    for r in hamming_topk.top_k(vectors, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbour_id))
    assert len(got) == len(rows)
    for q, found in got.items():
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:4]
        assert sorted(found) == [(n + 1, *w) for n, w in enumerate(want)]


def test_probes_and_comparisons_find_the_same_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    value = np.sort(np.concatenate([rng.integers(0, 1 << 10, 300), np.full(50, 77)]))
    own = np.concatenate([rng.integers(0, 1 << 10, 30), [77, 77]])
    for rows in (64, 1 << 17):
        monkeypatch.setattr(hamming_topk, "PROBE_ROWS", rows)
        for differing in (0, 1, 2, 3, 5, 10):  # up to 3 by probes, 5 has more probes than there are values
            got = sorted((int(a), int(b)) for x, y in hamming_topk._pairs(value, own, 10, differing) for a, b in zip(x, y))
            assert got == [(a, b) for a in range(32) for b in range(350) if (int(own[a]) ^ int(value[b])).bit_count() == differing]


def test_classifier_is_accurate_on_held_out_rows(spark):
    from conftest_llm import SF

    scored = queries.op2_nb_svm(spark, SF.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_classifier_learns_nothing_from_held_out_rows(spark, documents):
    from conftest_llm import SF

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(queries.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    train = lambda x: nb_svm.train(documents, x, "quality", ~queries.held_out(F.col("id")))
    a, b = train(labels), train(wrong)
    assert (a.weight == b.weight).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_classifier_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (100, 1), (101, 0), (102, 5)], "doc_id long, quality int")
    model = nb_svm.train(edge_docs, labels, "quality")
    rows = nb_svm.classify(edge_docs, model, carry=["row"]).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert nb_svm.classify(no_docs, model).count() == 0
    for some, share in ((labels.where("1 = 0"), 0.5), (labels.where("quality = 1"), 1.0)):
        one = nb_svm.classify(edge_docs, nb_svm.train(edge_docs, some, "quality")).collect()
        assert all(abs(r.score - share) < 1e-3 for r in one)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    label = np.where(rng.random(400) < 0.3, -1, 1)
    index = np.stack([np.where(label > 0, 3, 7), rng.integers(10, 50, 400)], 1).ravel().astype(np.int32)
    begin = np.arange(0, 801, 2)
    w = nb_svm.dual_coordinate_descent(index, begin, np.ones(64), label)
    margin = np.array([w[index[a:b]].sum() for a, b in zip(begin[:-1], begin[1:])]) / np.sqrt(2) + w[-1]
    assert ((margin > 0) == (label > 0)).all()
