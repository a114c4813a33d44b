"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from regionhour.llm import (conversation_repair, exact_dedup, language, mixing, near_dedup, neighbours, personal_data, pieces, quality_rules,
                            toxicity, url_filter, warc, whitening)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_personal_data": personal_data.op2_personal_data,
        "op3_language": language.op3_language,
        "op4_warc": warc.op4_warc,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_nearest": neighbours.op10_nearest,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_quality_rules": quality_rules.op12_quality_rules,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    own = {"op4_warc": warc.OP4_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op11_conversation_repair": conversation_repair.OP11_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in own.items() if sql}
