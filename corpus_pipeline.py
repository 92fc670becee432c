"""A corpus pipeline of five stages over the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesmart.llm import decontaminate, langid, near_copies, packing, secret_scan
from salesmart.llm.common import materialise, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with enough certainty stay; null texts and texts without letters go.

    Every row is judged by its own text, read whole, so repeated rows stay or go alike. An empty table stays empty,
    and all columns stay, whatever their names.
    """
    ship(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Null and empty texts, rows with a null doc_id, ties and repeated rows are as ``near_copies.keep_one`` says. An
    empty table stays empty, texts are read whole, and all columns stay, whatever their names.
    """
    ship(spark)
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay.

    Rows of one doc_id go together. An empty table, or an empty benchmark, leaves the rest as it is; texts are read
    whole, and all columns stay, whatever their names.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; all rows stay, repeated ones too, null and empty texts as they are.

    An empty table stays empty, texts are masked whole, and all columns stay, whatever their names.
    """
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences, in place of the documents' columns.

    Null texts count as empty and make one piece; repeated rows and null ids are packed each; texts are tokenized
    whole; an empty table gives no pieces.
    """
    ship(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the trained classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None
