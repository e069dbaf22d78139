"""The queries of this subpackage: opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, importance, media, near_duplicates, pieces, quality, secret_scan, sharding, substring_dedup, token_files, url_filter, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_sharding": sharding.op2_sharding,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_secret_scans": secret_scan.op4_secret_scans,
    "op5_token_files": token_files.op5_token_files,
    "op6_jaccard_join": near_duplicates.op6_jaccard_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_media_columns": media.op9_media_columns,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_url_filters": url_filter.op12_url_filters,
    "op13_importance_resampling": importance.op13_importance_resampling,
    # Operator 10 on calls and results made of the same table, which has none itself.
    "chat_tool_calls": chat.chat_tool_calls,
}

ORACLES: dict[str, str] = {
    "op2_sharding": sharding.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op4_secret_scans": secret_scan.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "chat_tool_calls": chat.CALLS_ORACLE,
    "op11_spelling_variants": variants.ORACLE,
    "op12_url_filters": url_filter.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
