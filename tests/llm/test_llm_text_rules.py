import collections

import pytest
from conftest_llm import as_rows, duck
from fusionlens.llm import backoff, line_rules, super_kmers
from pyspark.sql import functions as F


def brute_rules(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = collections.Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    unique = list(dict.fromkeys(lines))

    py = lambda pattern: pattern.replace("\\z", "\\Z")
    ended = lambda line: bool(re.search(py(line_rules.END_MARK), line))
    prose = 100 * sum(map(ended, lines)) >= 60 * len(lines)

    def fails(line):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        items = len(re.findall(line_rules.SEPARATOR, line))
        return (items >= 1 and n - items <= 3 * (items + 1)) or (
            prose and n >= 6 and not ended(line) and not re.search(line_rules.SENTENCE_END, line)) or any(
            len(re.findall(p, line)) >= 3 and 4 * len(re.findall(p, line)) >= n for p in (r"[#*$%&|<>]", "!!")) or bool(
            re.search(py(line_rules.BOILERPLATE), line))

    kept = [x for x in unique if not fails(x)]
    chars = lambda s: len(re.sub(r"[\x20\x09-\x0D]", "", s))
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), chars(text), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(unique), len(covered), base,
            not base and 100 * sum(map(chars, kept)) >= 70 * chars(text),
            text if len(kept) == len(lines) else "\n".join(kept))


def test_line_rules_match_brute_force(edge_docs, edge_rows):
    got = line_rules.apply_rules(edge_docs).collect()
    want = [(r[0], *brute_rules(r[1])) for r in edge_rows]
    assert as_rows(got) == as_rows(want)


def test_line_rules_remove_lines_before_judging(spark):
    body = " ".join(f"word{i}" for i in range(60)) + "."
    menu = "Home | About | Contact | Shop"
    docs = spark.createDataFrame([(1, f"{menu}\n{body}"), (2, "\n".join([menu + str(i) for i in range(20)]) + "\n" + "short text."),
                                  (3, f"{body}\nAll Rights Reserved 2020")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.clean_text) for r in line_rules.apply_rules(docs).collect()}
    assert got[1] == (True, body) and got[2][0] is False and got[3] == (True, body)


@pytest.mark.parametrize("line, fails", [
    ("Home > News > Sport", True), ("About | Contact", True), ("That | one thing | on.", True), ("A long sentence of prose | with a bar.", False),
    ("A Heading", False), ("a line of many words that just stops", True), ("one of many words that ends here.", False), ("One sentence ends. The next one of these is cut", False),
    ("Copyright 2021 Somebody Inc.", True), ("https://example.org/x?y=1", True), ("see https://example.org for the rest.", False),
    ("12 comments", True), ("He made 12 comments on it.", False), ("Buy now!! Cheap!! Go!!", True)])
def test_rules_of_one_line(spark, line, fails):
    body = [" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(12)]
    docs = spark.createDataFrame([(1, "\n".join([*body, line]))], "doc_id long, text string")
    r = line_rules.apply_rules(docs).first()
    assert (line not in r.clean_text.split("\n")) == fails and r.kept


@pytest.mark.parametrize("name", ["op1_backoff", "op5_super_kmers", "op10_line_rules"])
def test_edge_rows_match_sql(spark, edge_docs, name):
    op = {"op1_backoff": backoff.score,
          "op5_super_kmers": lambda d: super_kmers.remove_repeats(d).select(
              "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")),
          "op10_line_rules": lambda d: line_rules.apply_rules(d).drop("clean_text")}[name]
    got = op(edge_docs)
    assert as_rows(got.collect()) == as_rows(duck(name, edge_docs, got.columns))


def test_empty_tables(no_docs):
    assert line_rules.apply_rules(no_docs).count() == 0
    assert super_kmers.remove_repeats(no_docs).count() == 0
    assert backoff.score(no_docs).count() == 0


def test_super_kmers_with_hot_minimisers(edge_docs, monkeypatch):
    plain = as_rows(super_kmers.remove_repeats(edge_docs).collect())
    monkeypatch.setattr(super_kmers, "HOT", 1)  # every shared minimiser is hot
    assert as_rows(super_kmers.remove_repeats(edge_docs, share_bytes=20_000).collect()) == plain
    monkeypatch.setattr(super_kmers.blocks, "BLOCK_BYTES", 2_000)  # and copies lie in many blocks
    assert as_rows(super_kmers.remove_repeats(edge_docs, share_bytes=20_000).collect()) == plain
    monkeypatch.setattr(super_kmers, "HOT", 10_000)
    assert as_rows(super_kmers.remove_repeats(edge_docs, share_bytes=20_000).collect()) == plain


def test_super_kmers_survive_hash_collisions(edge_docs, monkeypatch):
    import numpy as np

    some = edge_docs.where("doc_id < 50")
    plain = as_rows(super_kmers.remove_repeats(some).collect())
    real = super_kmers._Words.run_hash
    batch = some.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(super_kmers._Words, "run_hash", lambda self, first, n: real(self, first, n) % np.uint64(50))
    w, m = super_kmers.WINDOW, super_kmers.MINI
    for hot in (0, 1, 10_000):
        flags = super_kmers._flag(super_kmers._send_values(0, batch, 1, w, m), hot)
        answer = super_kmers._answer(super_kmers._send(0, batch, flags, 1, w, m), w)
        got = super_kmers._remove(batch, answer, w, m, False).to_pylist()
        assert as_rows([tuple(r.values()) for r in got]) == plain


def test_backoff_with_a_corpus_and_order_three(spark):
    import math

    corpus = ["a b c d", "a b c e", "b c d"]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c e zz"), (3, None)], "doc_id long, text string")
    model = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in backoff.score(docs, model, order=3).collect()}
    want1 = math.log(2 / 11) + math.log(2 / 2) + math.log(2 / 2) + math.log(2 / 3)  # b c d: 2 of 3 after b c
    assert got[1] == pytest.approx(want1, abs=1e-5)
    want2 = math.log(3 / 11) + math.log(1 / 3) + math.log(0.4 ** 3 / 11)
    assert got[2] == pytest.approx(want2, abs=1e-5) and got[3] == 0


def brute_backoff(texts, order):
    import math

    words = [(t or "").split() for t in texts]
    grams = [collections.Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
    whole = sum(grams, collections.Counter())
    n = sum(map(len, words))
    for w, own in zip(words, grams):
        count = lambda g: whole[g] - own[g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            most = min(i + 1, order)
            for k in range(most, 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                if count(g) > 0 and k > 1:
                    ratio = count(g) / max(count(g[:-1]), 1) * 0.4 ** (most - k)
                    break
            else:
                ratio = max(count(g), 1) / max(n - len(w), 1) * 0.4 ** (most - 1 + (count(g) <= 0))
            score += round(math.log(ratio) * 1e6) / 1e6
        yield score


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_backoff_sees_four_words_of_context(spark, monkeypatch, block_bytes):
    import random

    monkeypatch.setattr(backoff.blocks, "BLOCK_BYTES", block_bytes)  # n-grams shared within a block, and between blocks
    rng = random.Random(3)
    phrases = [" ".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(30)]
    texts = [" ".join(rng.choices(phrases, k=rng.randint(1, 9))) for _ in range(60)] + [None, "", "zz", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.log_score for r in backoff.score(docs).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(brute_backoff(texts, 5)), abs=2e-5)
    assert list(brute_backoff(texts, 2)) != pytest.approx(list(brute_backoff(texts, 5)), abs=2e-2)
