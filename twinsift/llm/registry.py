"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import chat, decontamination, langid, lines, lm_scoring, mixing, oracles, quality, sharding, simhash, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pareto_mix": mixing.op1_pareto_mix,
        "op2_language_id": langid.op2_language_id,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_chat_format": chat.op4_chat_format,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_lm_scoring": lm_scoring.op6_lm_scoring,
        "op7_simhash": simhash.op7_simhash,
        "op8_sharding": sharding.op8_sharding,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_substring_dedup": substrings.op10_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
