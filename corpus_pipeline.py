"""The corpus pipeline: stages over documents, each written and read by the next.

Language ID, toxicity, near duplicates and decontamination keep rows of documents with all
their columns, language ID adds the language it finds; packing turns what is left into pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, language, near_dup, packing, toxicity
from gridloom.llm.common import materialize, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each text's language as ``lang_pred``, and drops what is ``und``: null texts and those without a letter."""
    return language.keep_known(spark, docs, sf_dir)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.7 or more."""
    return toxicity.keep_clean(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near duplicates."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth of the words or more is in benchmark windows."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Concatenates and cuts what is left into sequences of 2048 ids, each of one language."""
    return packing.piece_rows(docs, "lang_pred" if "lang_pred" in docs.columns else None)


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]
#: Learned models and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
