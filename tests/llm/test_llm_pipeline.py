import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest_llm import as_rows
from fusionlens.llm import nb_svm, queries
from test_llm_similarity import expected
from test_llm_text_rules import brute_rules
from test_llm_tokens import check_pieces, library

COLUMNS = corpus_pipeline.COLUMNS


def brute_repeats(rows, width=13):
    import re

    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    low = {}
    big = 1 << 63
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            low[k] = min(low.get(k, big), big if d is None else d)
    out = []
    for (d, w), (_, text) in zip(words, rows):
        gone = set()
        for i in range(len(w) - width + 1):
            if low[tuple(w[i:i + width])] < (big if d is None else d):
                gone.update(range(i, i + width))
        out.append((d, text or "" if not gone else " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def run_stages(spark, docs, sf):
    model = queries.quality_model(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "packing"]

    one = stages["quality_rules"](spark, docs, sf).cache()
    judged = [(d, brute_rules(t)) for d, t in rows_of(docs)]
    assert as_rows(rows_of(one)) == as_rows((d, v[-1]) for d, v in judged if v[-2])

    two = stages["quality_classifier"](spark, one, sf).cache()
    import pyarrow as pa

    before = rows_of(one)
    score = model.scores(*nb_svm.features(pa.array([t for _, t in before], pa.string()))) if before else []
    assert as_rows(rows_of(two)) == as_rows(r for r, s in zip(before, score) if s >= 0.7)

    three = stages["near_dedup"](spark, two, sf).cache()
    before = rows_of(two)
    roots = expected(before)[1]
    chosen = {}
    for r, root in zip(before, roots):
        key = (r[0] is None, r[0] or 0)
        chosen[root] = min(chosen.get(root, key), key)
    assert sorted((r[0] is None, r[0] or 0) for r in rows_of(three)) == sorted(chosen.values())
    assert set(rows_of(three)) <= set(before)

    four = stages["substring_dedup"](spark, three, sf).cache()
    assert as_rows(rows_of(four)) == as_rows(brute_repeats(rows_of(three)))
    for df in (one, two, three, four):
        assert df.columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in df.collect()) or df is three

    five = stages["packing"](spark, four, sf).collect()
    after = rows_of(four)
    ids = library(public_tokenizers.path("word_bpe_49k.json"), [t for _, t in after])
    check_pieces(five, [(d, x + [2]) for (d, _), x in zip(after, ids)])
    return four


def test_pipeline_matches_plain_versions(spark, documents):
    from conftest_llm import SF

    kept = run_stages(spark, documents, SF)
    assert 0 < kept.count() < documents.count()


def test_pipeline_on_edge_rows(spark, edge_docs, no_docs):
    from conftest_llm import SF

    run_stages(spark, edge_docs, SF)
    docs = no_docs.select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_writes_every_stage(spark):
    from conftest_llm import SF

    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(pieces.columns)
