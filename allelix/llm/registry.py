"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from allelix.llm import byte_bpe, collocations, embeddings, language_id, language_model, line_dedup, packing, quality, resampling, simhash, suffix_dedup, token_counts, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_packing": packing.op3_packing,
        "op4_language_model": language_model.op4_language_model,
        "op5_language_id": language_id.op5_language_id,
        "op6_warc": warc.op6_warc,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_embeddings": embeddings.op8_embeddings,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_simhash": simhash.op10_simhash,
        "op11_resampling": resampling.op11_resampling,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.ORACLE_SQL,
        "op6_warc": warc.ORACLE_SQL,
        "op11_resampling": resampling.ORACLE_SQL,
        "op12_line_dedup": line_dedup.ORACLE_SQL,
        "op13_collocations": collocations.ORACLE_SQL,
    }
