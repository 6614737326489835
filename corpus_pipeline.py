"""The corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the docs of the
next one. All stages but the last return the columns of documents. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import op2_packing, op5_minhash, op7_language, op8_secrets, op9_decontamination
from tidewell.llm.tokenizers_io import public_path
from tidewell.session import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text no learned language accepts: null, without a letter, or far from all centroids.

    Learns from rows that have a lang and a doc_id, outside the held-out quarter. Repeated rows and rows with a null
    doc_id are judged like any other; of centroids with equal cosine the first one counts. Without rows to learn from all
    documents go; an empty table gives an empty one. Texts of any length are read whole. All columns of docs come back as
    they are, whatever their names.
    """
    return op7_language.accepted(docs, op7_language.train(op7_language.learning_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near-duplicates.

    Null texts and texts without words are linked with nothing and stay, as do rows with a null doc_id. Of repeated rows
    one stays; of rows with one doc_id the one with the smallest hash of the text. An empty table gives an empty one. All
    columns of docs come back as they are, whatever their names.
    """
    return op5_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts hold none, and an empty benchmark drops nothing. Repeated rows, and rows with equal or null
    doc_ids, are judged each by its text. Texts of any length are searched whole. An empty table gives an empty one. All
    columns of docs come back as they are, whatever their names.
    """
    return op9_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document is dropped, and n_chars, where there is one, follows the text.

    Null texts stay null. Repeated rows are treated alike; overlapping secrets become one mark. An empty table gives an
    empty one. Texts of any length are scanned whole. All other columns of docs come back as they are, whatever their names.
    """
    return op8_secrets.without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences.

    A null text is empty and gives a piece with the end id alone. Repeated rows are packed each; ties are settled as
    op2_packing says. An empty table gives no rows. Texts of any length are encoded whole. Other columns are ignored.
    """
    pieces = stored(op2_packing.document_pieces(docs, public_path("word_bpe_49k.json")), "pieces")
    return op2_packing.pack(pieces)


STAGES = [
    ("language_7", language),
    ("near_duplicates_5", near_duplicates),
    ("decontamination_9", decontamination),
    ("secrets_8", secrets),
    ("packing_2", packing),
]

#: Tokenizers and trained models can't be expressed in SQL; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
