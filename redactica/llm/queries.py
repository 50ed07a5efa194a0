"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from redactica.llm import chat, decontaminate, ledger, merkle, packing, quality, records, sharding, simhash, spelling, substring, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.query,
        "op2_simhash": simhash.query,
        "op3_records": records.query,
        "op4_packing": packing.query,
        "op5_toxicity": toxicity.query,
        "op6_substring": substring.query,
        "op7_quality": quality.query,
        "op8_chat": chat.query,
        "op9_sharding": sharding.query,
        "op10_topk": topk.query,
        "op11_ledger": ledger.query,
        "op12_spelling": spelling.query,
        "op13_merkle": merkle.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op6_substring": substring.SQL, "op8_chat": chat.SQL, "op10_topk": topk.SQL, "op11_ledger": ledger.SQL, "op12_spelling": spelling.SQL, "op13_merkle": merkle.SQL}
