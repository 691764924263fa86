"""Token counts with the whole-token shortcut.

Once, on the driver, every string of the vocabulary is encoded alone; those
that come back as the one token they are form the proven set (at most as many
entries as the vocabulary, broadcast). A pre-token in the set counts as one
token without any merging; only other pre-tokens are merged.

Edge cases: a NULL text is an empty text (0 tokens); NULL ids are carried
through; repeated rows give repeated results; an empty table gives an empty
result; extra columns are not read. A text longer than a slice is counted in a
slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusionlens.llm import chunks, encoders


def proven(raw: bytes) -> tuple[list[str], list[bytes]]:
    """Vocabulary strings that encode alone as one token: as the library spells them, and as text bytes."""
    tok = encoders.tokenizer(raw)
    special = set(encoders.special_strings(raw))
    vocab = tok.get_vocab(with_added_tokens=False)
    spelled = [s for s, i in vocab.items() if [t.id for t in tok.model.tokenize(s)] == [i]]
    byte_of = {c: b for b, c in encoders.byte_letters().items()}
    texts = []
    for s in spelled:
        text = bytes(byte_of[c] for c in s).decode("utf-8", "ignore")
        if text and text.encode() not in special:
            texts.append((text, vocab[s]))
    alone = [t.encode() for (t, i), e in zip(texts, tok.encode_batch_fast([t for t, _ in texts], add_special_tokens=False))
             if e.ids == [i]]
    return spelled, alone


def counter(raw: bytes, spelled: set[str], alone: set[bytes]):
    """Numbers of tokens of byte strings."""
    tok = encoders.tokenizer(raw)
    special = encoders.special_strings(raw)
    cut, merge = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize

    def count(keys: list[bytes]) -> list[int]:
        out = []
        for key in keys:
            if key in alone:
                out.append(1)
            elif encoders.is_piece(key, special):
                out.append(len(merge(encoders.spelled(key))))
            elif any(s in key for s in special):
                out.append(len(tok.encode(key.decode("utf-8", "replace"), add_special_tokens=False).ids))
            else:
                out.append(sum(1 if p in spelled else len(merge(p)) for p, _ in cut(key.decode("utf-8", "replace"))))
        return out

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of each row; ``vocabulary`` is a byte-level file's path."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        raw = f.read()
    table = spark.sparkContext.broadcast((raw, *proven(raw)))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, spelled, alone = table.value
        memory = encoders.once(("count", vocabulary), lambda: chunks.Remembered(
            counter(raw, set(spelled), set(alone)), counts=True))
        special = encoders.special_strings(raw)
        for batch in batches:
            for part in chunks.slices(batch, "text"):
                buf, at = chunks.text_bytes(part.column(1))
                starts, ends, row = encoders.byte_level_pieces(buf, at, special)
                size = memory.of_ranges(buf, starts, ends)[1] if len(starts) else np.zeros(0, np.int64)
                total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[row]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(np.diff(total))], ["doc_id", "n_bytes", "n_tokens"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
