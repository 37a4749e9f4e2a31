"""The registry of this subpackage: one query per operator, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Module and query of each operator.
OPERATORS = {
    "op1_ngram_jaccard_join": "near_dup",
    "op2_benchmark_decontamination": "decontaminate",
    "op3_warc": "warc",
    "op4_packing": "packing",
    "op5_toxicity": "toxicity",
    "op6_language_id": "language",
    "op7_token_file": "token_file",
    "op8_token_counts": "token_counts",
    "op9_exact_top_k": "topk",
    "op10_chat_formatting": "chat",
    "op11_hard_negatives": "hard_negatives",
    "op12_vector_codes": "vector_codes",
    "op13_document_fingerprints": "fingerprint",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in OPERATORS.items():
        sql = getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
        out |= {k: v for k, v in sql.items() if k == name}
    return out
