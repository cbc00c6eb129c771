"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gramloom.llm import (
    chatformat, collocations, decontamination, exactdedup, htmltext, langid, licensescan, neardup, qualityrules, secretscan, sentencepieces, sharding, tokenalign,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": neardup.op1_jaccard_join,
    "op2_html_text": htmltext.op2_html_text,
    "op3_language_id": langid.op3_language_id,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_secret_scan": secretscan.op5_secret_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_chat_format": chatformat.op7_chat_format,
    "op8_exact_dedup": exactdedup.op8_exact_dedup,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_license_scan": licensescan.op10_license_scan,
    "op11_collocations": collocations.op11_collocations,
    "op12_quality_rules": qualityrules.op12_quality_rules,
    "op13_token_alignment": tokenalign.op13_token_alignment,
}
SQL: dict[str, str] = {
    "op1_jaccard_join": neardup.SQL,
    "op6_sharding": sharding.SQL,
    "op8_exact_dedup": exactdedup.SQL,
    "op9_decontamination": decontamination.SQL,
    "op10_license_scan": licensescan.SQL,
    "op11_collocations": collocations.SQL,
    "op12_quality_rules": qualityrules.SQL,
}
