"""n-grams of a block: counts against a plain count; only those that may repeat are sorted."""

from collections import Counter

import numpy as np
import pyarrow as pa

from fusionlens.llm import backoff


def test_counts_of_a_block_and_what_is_sorted():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in np.minimum(rng.geometric(0.2, n), 30)) for n in rng.integers(0, 60, 40)] + ["", None, "w1", "w1 w2"]
    texts += ["a passage that two rows hold whole"] * 2
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    grams = backoff._Grams(batch, 5)
    rows = [(t or "").split() for t in texts]
    flat = [w for r in rows for w in r]
    for k in range(1, 6):
        plain = Counter(tuple(r[i:i + k]) for r in rows for i in range(len(r) - k + 1))
        found = [tuple(flat[s:s + k]) for s in grams.starts[k - 1].tolist()]
        assert grams.count[k - 1][grams.kind[k - 1]].tolist() == [plain[g] for g in found]
        keys = grams.keys(k, np.ones(len(plain), dtype=bool))
        assert len(set(keys.tolist())) == len(plain)
        assert np.array_equal(keys[grams.kind[k - 1]], grams.words.run_hash(grams.starts[k - 1], k))
        if k > 2:
            shorter = Counter(tuple(r[i:i + k - 1]) for r in rows for i in range(len(r) - k + 2))
            maybe = [g for g in found if shorter[g[1:]] > 1 and shorter[g[:-1]] > 1]
            assert len(grams.sorted[k - 1]) == len(set(maybe)) < len(plain)
