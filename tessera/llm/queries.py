"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, langid, licenses, line_dedup, mixing, quality, secret_scan, simhash, suffix_dedup, token_orc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontam.op1,
        "op2_secret_scan": secret_scan.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_token_orc": token_orc.op4,
        "op5_simhash": simhash.op5,
        "op6_host_quality": quality.op6,
        "op7_language": langid.op7,
        "op8_license_scan": licenses.op8,
        "op9_suffix_dedup": suffix_dedup.op9,
        "op10_mixture": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontam.OP1_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op6_host_quality": quality.OP6_SQL,
        "op8_license_scan": licenses.OP8_SQL,
        "op10_mixture": mixing.OP10_SQL,
    }
