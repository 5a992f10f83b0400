"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorfield.llm import chat, decontaminate, licenses, mixing, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_decontamination": decontaminate.op1_template_decontamination,
        "op2_toxicity_fm": toxicity.op2_toxicity_fm,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_prefix_token_counts": token_counts.op4_prefix_token_counts,
        "op5_chat_formatting": chat.op5_chat_formatting,
        "op6_exact_top_k": topk.op6_exact_top_k,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_pfair_mixing": mixing.op8_pfair_mixing,
        "op9_suffix_array_dedup": suffix_dedup.op9_suffix_array_dedup,
        "op10_url_path_templates": url_filter.op10_url_path_templates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": chat.OP5_SQL, "op6_exact_top_k": topk.OP6_SQL}
