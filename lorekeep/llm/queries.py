"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_tree, decontaminate, exact_dedup, host_reputation, language_id, lm_score, pii, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_chat_tree": chat_tree.op4_chat_tree,
    "op5_simhash": simhash.op5_simhash,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_language_id": language_id.op8_language_id,
    "op9_host_reputation": host_reputation.op9_host_reputation,
    "op10_lm_score": lm_score.op10_lm_score,
}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_decontaminate": decontaminate.SQL,
    "op9_host_reputation": host_reputation.SQL,
}
