"""From raw documents to packed training sequences: five stages, each a DataFrame from a DataFrame.

Every stage but the last returns the columns of its input. A stage that runs alone takes what the one before it kept.
Null, empty and very long texts, ties, repeated rows, empty tables and further columns are handled as the operator of
the stage says; columns that are not named here pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import decontam, exact, langid, near, pack
from tenura.llm.common import free, saved
from tenura.llm.queries import language_model, table, vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows: at least half of their letters are in scripts of learned languages. Texts that are null or have no letter go.

    Learned from the labels of the table ``documents``.
    """
    found = free(docs, "language")
    return langid.label(docs, language_model(spark, sf_dir), out=found).where((F.col(found)["lang"] != "und") & (F.col(found)["known"] >= 0.5)).drop(found)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id."""
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets, the one with the least id."""
    return near.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    found = free(docs, "contaminated")
    return decontam.find_items(docs, table(spark, sf_dir, "benchmark"), out=found).where(F.size(found) == 0).drop(found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 1024 tokens."""
    return pack.pack(docs, vocabulary())


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("best-fit packing", packed),
]

#: Language models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
