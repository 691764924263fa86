import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fusionlens.llm import encoders, harmonic, prefix_bpe, queries, repair_codec, token_shortcut
from fusionlens.session import shared_path
from tokenizers import Tokenizer

WORD_BPE, BYTE_BPE, RANKS = (public_tokenizers.path(n) for n in (
    "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


def library(path, texts):
    tok = Tokenizer.from_file(path)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def odd_texts(n=4000):
    rng = random.Random(1)
    letters = list(" \n\t\r\x0b\x0c\x1c\x85\xa0 　ab'stdABé中字1٣!|<>&́​×÷ÀÞßÿ5") + [
        "<|endoftext|>", "<|startoftext|>", "  ", "\n\n", " the", "'s", "ing"]
    return ["".join(rng.choices(letters, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("path,byte_level", [(BYTE_BPE, True), (WORD_BPE, False)])
def test_pieces_give_the_librarys_ids(path, byte_level):
    import pyarrow as pa
    from fusionlens.llm import chunks

    with open(path, "rb") as f:
        raw = f.read()
    special, texts = encoders.special_strings(raw), odd_texts() + [None, ""]
    memory = chunks.Remembered(encoders.library_ids(encoders.tokenizer(raw), special), limit=500)
    ids, at = encoders.row_ids(pa.array(texts), memory, special, byte_level)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library(path, texts)


def test_token_counts(edge_docs, edge_rows, no_docs):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_shortcut.count_tokens(edge_docs, BYTE_BPE).collect())
    ids = library(BYTE_BPE, [r[1] for r in edge_rows])
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(x), len(x) > 1024) for r, x in zip(edge_rows, ids))
    assert token_shortcut.count_tokens(no_docs, BYTE_BPE).count() == 0


def test_proven_tokens_encode_alone():
    with open(BYTE_BPE, "rb") as f:
        spelled, alone = token_shortcut.proven(f.read())
    sample = random.Random(2).sample(alone, 2000)
    assert all(len(x) == 1 for x in library(BYTE_BPE, [s.decode() for s in sample])) and len(spelled) > 40_000


def test_prefix_encoding_matches_the_library_and_decodes(edge_docs, edge_rows, no_docs):
    ranks = prefix_bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in prefix_bpe.encode_and_decode(
        edge_docs, RANKS, public_tokenizers.PATTERN).collect())
    want = sorted((r[0] or -1, np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in edge_rows)
    assert got == want
    assert prefix_bpe.encode_and_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_tables_append_and_edit():
    ranks = prefix_bpe.read_ranks(RANKS)
    e = prefix_bpe.PrefixEncoder(ranks, prefix_bpe.halves(ranks))
    rng = random.Random(4)
    whole = lambda b: [ranks[p] for p in prefix_bpe.merged(b, ranks)]
    for _ in range(300):
        data = bytes(rng.choices(b"abcdefghilmnorstu \xc3\xa9", k=rng.randint(1, 30)))
        last = e.extend(data, [])
        assert e.tokens(data, last) == whole(data)
        longer, more = e.append(data, last, b"ing")
        assert e.tokens(longer, more) == whole(longer)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        new, table = e.replace(data, last, a, b, b"xy")
        assert table[:a] == last[:a] and e.tokens(new, table) == whole(new)


def check_pieces(pieces, docs, capacity=4096):
    covered = {}
    for r in sorted(pieces, key=lambda r: (str(r.doc_id), r.start)):
        covered.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    by = {}
    for doc_id, ids in docs:
        by.setdefault((doc_id, len(ids)), []).append(np.array(ids, "<u4"))
    assert {k: sum(r.length for r in v) for k, v in covered.items()} == {k: k[1] * len(v) for k, v in by.items()}
    for key, rows in covered.items():
        for r in rows:
            assert any(x[r.start:r.start + r.length].tobytes() == bytes(r.ids) for x in by[key])
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0  # a power of two: no padding


def test_packing(edge_docs, edge_rows, no_docs):
    pieces = harmonic.pack(edge_docs, WORD_BPE).collect()
    check_pieces(pieces, [(r[0], x + [2]) for r, x in zip(edge_rows, library(WORD_BPE, [r[1] for r in edge_rows]))])
    assert harmonic.pack(no_docs, WORD_BPE).count() == 0


def test_harmonic_plan_fills_classes_with_a_fixed_number_of_documents():
    lengths = np.full(300, 1300)  # class 3: C/4 < 1300 <= C/3
    bins = harmonic.plan(lengths, 4096)
    whole = [sum(1 for _, s, n in b if s == 0 and n == 1300) for b in bins[:50]]
    assert set(whole) <= {2, 3} and all(sum(n for _, _, n in b) == 4096 for b in bins[:50])
    rng = np.random.default_rng(0)
    for n in (1, 5, 400):
        lengths = rng.integers(1, 9000, n)
        bins = harmonic.plan(lengths, 4096)
        seen = [np.zeros(x, int) for x in lengths]
        for b in bins:
            for d, s, k in b:
                seen[d][s:s + k] += 1
        assert all((x == 1).all() for x in seen)
        assert sum(sum(k for *_, k in b) != 4096 for b in bins) <= 12


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for _ in range(120):
        ids = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(1, 300))).astype(np.int64)
        ids[rng.random(len(ids)) < 0.1] = repair_codec._END
        ids[-1] = repair_codec._END
        grammar = repair_codec.Grammar.read(repair_codec.compress(ids, repair_codec._END, rounds=20, min_count=2))
        whole, at = grammar.documents()
        assert (whole == ids).all()
        for i in range(len(at) - 1):
            doc = ids[at[i]:at[i + 1]]
            start = int(rng.integers(0, len(doc)))
            n = int(rng.integers(1, len(doc) - start + 1))
            assert (grammar.document(i) == doc).all() and (grammar.ids(i, start, n) == doc[start:start + n]).all()


def test_repair_files_keep_order_and_ids(spark, edge_docs, edge_rows, no_docs):
    path = shared_path(spark, "test-ids")
    repair_codec.write_ids(edge_docs, path, BYTE_BPE)
    starts = {(r.part, r.shard): r.before for r in repair_codec.shard_starts(spark, path).collect()}
    got = sorted((starts[r.part, r.shard] + r.start, r.doc_id, bytes(r.ids)) for r in repair_codec.read_ids(spark, path).collect())
    rows = sorted(((r[0] is not None, r[0] or 0, (r[1] or "").encode(), r[0], x) for r, x in zip(
        edge_rows, library(BYTE_BPE, [r[1] for r in edge_rows]))), key=lambda r: r[:3])
    at, where = 0, {}
    for *_, doc_id, x in rows:
        where.setdefault(doc_id, []).append(np.array(x + [2], "<u4").tobytes())
    for start, doc_id, data in got:
        assert start == at
        at += len(data) // 4
    order = [d for _, d, _ in got]
    assert order == [r[3] for r in rows]
    for doc_id in where:
        assert sorted(where[doc_id]) == sorted(x for _, d, x in got if d == doc_id)
    empty = shared_path(spark, "test-ids")
    repair_codec.write_ids(no_docs, empty, BYTE_BPE)
    assert repair_codec.read_ids(spark, empty).count() == 0


def test_token_queries_on_all_documents(spark, documents):
    from conftest_llm import SF

    rows = documents.orderBy("doc_id").collect()
    ids = [np.array(x, "<u4") for x in library(BYTE_BPE, [r.text for r in rows])]
    counts = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op6_token_shortcut(spark, SF).collect()}
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_prefix_bpe(spark, SF).collect()}
    filed = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_repair(spark, SF).collect()}
    start = 0
    for r, x in zip(rows, ids):
        assert counts[r.doc_id] == (len(x), len(x) > 1024)
        assert coded[r.doc_id] == (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
        full = np.append(x, 2).astype("<u4")
        assert filed[r.doc_id] == (start, len(full), zlib.crc32(full.tobytes()))
        start += len(full)
