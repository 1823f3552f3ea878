"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import bpe, cdx, ctw, mixing, passages, pii, quality, simhash, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxic_windows": toxicity.query,
        "op2_host_rules": quality.query,
        "op3_context_tree": ctw.query,
        "op4_top_k": topk.query,
        "op5_compact_windows": passages.query,
        "op6_capture_index": cdx.query,
        "op7_bpe_tokens": bpe.query,
        "op8_pii_anchors": pii.query,
        "op9_mix_sources": mixing.query,
        "op10_simhash_forest": simhash.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_rules": quality.SQL, "op4_top_k": topk.SQL, "op6_capture_index": cdx.SQL, "op9_mix_sources": mixing.SQL}
