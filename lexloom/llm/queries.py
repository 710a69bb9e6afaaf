"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, chat, chunking, langid, packing, pitman_yor, secret_scan, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.query,
        "op2_pitman_yor": pitman_yor.query,
        "op3_secret_scan": secret_scan.query,
        "op4_language_id": langid.query,
        "op5_chunk_fingerprints": chunking.query,
        "op6_toxicity": toxicity.query,
        "op7_byte_bpe": byte_bpe.query,
        "op8_nearest_neighbours": ann.query,
        "op9_simhash": simhash.query,
        "op10_chat": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat": chat.ORACLE}
