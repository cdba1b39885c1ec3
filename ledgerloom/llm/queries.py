"""The registered queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import chat_format, exact_dedup, fingerprints, language_id, licenses, metric_search, mixing, near_dedup, packing, personal_data, prefix_trie, resampling, secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scans": secrets.op1_secret_scans,
        "op2_exact_top_k": metric_search.op2_exact_top_k,
        "op3_language_id": language_id.op3_language_id,
        "op4_chat_formatting": chat_format.op4_chat_formatting,
        "op5_personal_data": personal_data.op5_personal_data,
        "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
        "op7_mixing": mixing.op7_mixing,
        "op8_packing": packing.op8_packing,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_license_scans": licenses.op10_license_scans,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_conversation_trie": prefix_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_top_k": metric_search.OP2_SQL,
        "op7_mixing": mixing.OP7_SQL,
        "op10_license_scans": licenses.OP10_SQL,
        "op11_importance_resampling": resampling.OP11_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
        "op13_conversation_trie": prefix_trie.OP13_SQL,
    }
