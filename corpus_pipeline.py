"""The corpus pipeline: documents through five operators, stage by stage.

Each stage reads what the one before it wrote as a table. Rejected documents
go, near copies go but for one of each group, and repeated passages leave the
texts; the last stage packs the token ids of what is left. All stages but the
last return the columns of ``documents``, with ``n_chars`` counted again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fusionlens.llm import gray_simhash, harmonic, line_rules, nb_svm, queries, super_kmers
from fusionlens.llm.sizing import staged
from fusionlens.session import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(doc_id: Column, text: Column) -> list[Column]:
    """The columns of documents from the carried ``row``, with this text."""
    return [doc_id.alias("doc_id"), text.alias("text"), F.col("row.lang").alias("lang"),
            F.col("row.source").alias("source"), F.char_length(text).cast("long").alias("n_chars")]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failed lines leave the documents that stay.

    The judged rows are written before they are filtered: a filter on the
    verdict would be pushed below the rules and compute them twice. A NULL text is an
    empty text and is rejected; NULL ids and columns are carried; repeated rows
    are judged each; an empty table stays empty; extra columns are dropped.
    """
    judged = staged(line_rules.apply_rules(docs, carry=["lang", "source"]), "judged")
    return judged.where("kept").select(*_documents(F.col("doc_id"), F.col("clean_text")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be of low quality go.

    Empty and NULL texts get the score of a text without features; documents
    that have no label are scored alike; without labels all score 0.5 and go.
    """
    judged = nb_svm.classify(docs, queries.quality_model(spark, sf_dir), carry=["lang", "source"])
    return judged.where("predicted = 1").select(*_documents(F.col("doc_id"), F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Empty texts are copies of each other; of equal ids one row stays; a NULL id
    comes last. The contract's 4 bits on 4-word shingles find exact copies and
    small edits: the driver's check found 0.6 of its planted near copies.
    """
    kept = gray_simhash.one_of_each(docs, width=4, max_bits=4, carry=COLUMNS)
    return kept.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text that loses none stays as it was.

    A text that loses all its words stays as an empty one; NULL texts have no words.
    """
    cleaned = super_kmers.remove_repeats(docs, carry=["lang", "source"])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return cleaned.select(*_documents(F.col("doc_id"), text))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of at most 4096; an empty or NULL text is its end id alone."""
    return harmonic.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]
ORACLE_SQL = None  # token ids and fingerprints have no SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents``; each result is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
