"""What a task has met before is found by its bytes; pairs are found in a table or by search alike."""

import numpy as np
import pyarrow as pa
import pytest

from fusionlens.llm import chunks, encoders, repair_codec


def ranges(words):
    size = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), ends - size, ends


def words(seed, n=5000):
    rng = np.random.default_rng(seed)
    pool = [b"", b"\0", b"\0\0", b"a\0", b"a", b"abcdefg", b"abcdefg\0", b"abcdefgh", b"abcdefghijklmno", b"abcdefghijklmn\0",
            b"abcdefghijklmnop", b"abcdefghijklmnoq", "äöüß€𝄞".encode()]
    pool += [rng.integers(97, 100, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 20, 300)]
    return [pool[i] for i in rng.integers(0, len(pool), n)]


@pytest.mark.parametrize("limit", [10, 100, 400_000])
def test_ranges_keep_their_ids_whatever_is_forgotten(limit):
    memory = chunks.Remembered(lambda keys: [list(k) + [len(k)] for k in keys], limit=limit)
    for seed in (1, 2, 1, 3):
        some = words(seed)
        first, size = memory.of_ranges(*ranges(some))
        ids = memory.ids[chunks.ragged(first, size)].tolist()
        assert ids == [x for w in some for x in [*w, len(w)]]


def test_only_new_or_long_ranges_are_looked_up(monkeypatch):
    memory = chunks.Remembered(lambda keys: [len(k) for k in keys], counts=True)
    some = words(4)
    memory.of_ranges(*ranges(some))
    asked = []
    real = memory._look
    monkeypatch.setattr(memory, "_look", lambda keys: asked.extend(keys) or real(keys))
    assert memory.of_ranges(*ranges(some))[1].tolist() == [len(w) for w in some]
    assert sorted(asked) == sorted({w for w in some if len(w) > 15})


def test_a_full_table_leaves_strings_out(monkeypatch):
    monkeypatch.setattr(chunks._Spellings, "BITS", 4)
    memory = chunks.Remembered(lambda keys: [len(k) for k in keys], counts=True)
    for seed in (5, 6):
        some = words(seed)
        assert memory.of_ranges(*ranges(some))[1].tolist() == [len(w) for w in some]


def test_distinct_ranges_by_content():
    some = words(7)
    chosen, number = chunks.distinct(*ranges(some))
    assert [some[chosen[n]] for n in number] == some and len(chosen) == len(set(some))


def test_a_slice_whose_words_all_stand_in_odd_rows():
    memory = chunks.Remembered(lambda keys: [[len(k)] for k in keys])
    ids, at = encoders.row_ids(pa.array(["it's so", " €", None]), memory, [])
    assert ids.tolist() == [8, 6] and at.tolist() == [0, 1, 2, 2]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_by_table_and_by_search_make_one_grammar(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.02, 60_000), 400)
    ids[rng.integers(0, len(ids), 300)] = repair_codec._END
    ids[-1] = repair_codec._END
    both = []
    for cells in (1 << 24, 0):
        monkeypatch.setattr(repair_codec, "TABLE", cells)
        both.append(repair_codec.compress(ids, repair_codec._END))
    assert both[0] == both[1]
    back, _ = repair_codec.Grammar.read(both[0]).documents()
    assert np.array_equal(back, ids)
