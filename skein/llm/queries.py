"""The corpus queries: thin bindings of the operators to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import chat, decontaminate, divergence, jaccard, licences, lines, mixing, passages, personal, suffixes, topk, toxicity, whitening


def _bind(report: Callable, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _bind(mixing.report, "documents"),
        "op2_passages": _bind(passages.report, "documents"),
        "op3_topk": _bind(topk.report, "embeddings"),
        "op4_suffixes": _bind(suffixes.report, "documents"),
        "op5_lines": _bind(lines.report, "documents"),
        "op6_jaccard": _bind(jaccard.report, "documents"),
        "op7_licences": _bind(licences.report, "documents"),
        "op8_decontaminate": _bind(decontaminate.report, "documents", "benchmark"),
        "op9_toxicity": _bind(toxicity.report, "documents", "labels"),
        "op10_chat": _bind(chat.report, "conversations"),
        "op11_whitening": _bind(whitening.report, "embeddings"),
        "op12_personal": _bind(personal.report, "documents"),
        "op13_divergence": _bind(divergence.report, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_passages": passages.SQL, "op3_topk": topk.SQL, "op4_suffixes": suffixes.SQL, "op5_lines": lines.SQL, "op6_jaccard": jaccard.SQL, "op8_decontaminate": decontaminate.SQL, "op10_chat": chat.SQL, "op13_divergence": divergence.SQL}
