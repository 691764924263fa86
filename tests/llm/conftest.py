import random

import pytest
from conftest_llm import SF

# clashing names: columns that the operators use themselves
EXTRA = "block long, fp long, row string, share long, ids string, start long, n_words long, text_ string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty, very long, ties, repeats, odd white space, special strings."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "The", "été", "ß", "中文字", "a|b", "don't", "x=1"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    rows = [(1, passage, "en", "s"), (2, f"start {passage} end", "en", "s"), (3, passage, None, None),
            (3, passage, None, None), (3, "same id, other text " + passage, "en", "s"),
            (4, None, "en", "s"), (5, "", "en", "s"), (6, " \n\t ", "en", "s"), (None, passage, "en", "s"),
            (None, None, None, None), (7, long, "en", "s"), (8, long + " tail", "de", "s"),
            (9, "go go go go go go go go go go go go go go go go go go go go go", "en", "s"),
            (10, "a  b\n\nc  d e　f <|endoftext|> g\x1ch\x85i  ", "en", "s"),
            (11, "one line here.\none line here.\none line here.\n" + passage + ".", "en", "s"),
            (12, "Home | About | Contact | More\n" + passage + ".", "en", "s"), (13, "x" * 5000, "en", "s"),
            (14, "'s it's I'LL  'll\r\n\x0b\x0c", "en", "s"), (15, "Ａ́é é İ ΣΑΣ", "en", "s")]
    rows += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))), "en", "s") for i in range(40)]
    rows += [(200 + i, passage + f" {rng.choice(vocabulary)}", "en", "s") for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    names = [f.split()[0] for f in EXTRA.split(", ")]
    kinds = [f.split()[1] for f in EXTRA.split(", ")]
    other = tuple(5 if k == "long" else "z" for k in kinds)
    rows = [(*r, len(r[1]) if r[1] is not None else None, *other) for r in edge_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").select(
        "doc_id", "text", "lang", "source", "n_chars", *names)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")
