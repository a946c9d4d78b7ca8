"""Queries and SQL of this folder, added to the entry file when the folder is there."""

from __future__ import annotations

import corpus_pipeline

from . import balance, chat, filters, fingerprints, licenses, mixing, packing, quality, ranking, simhash, tokencount, toxicity, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mixing": mixing.op1_mixing,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_chat_formatting": chat.op3_chat_formatting,
        "op4_token_counts": tokencount.op4_token_counts,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_warc": warc.op8_warc,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_filter_interactions": filters.op11_filter_interactions,
        "op12_balanced_packing": balance.op12_balanced_packing,
        "op13_ranked_search": ranking.op13_ranked_search,
        "quality_policies": quality.quality_policies,
        "quality_ablation": quality.quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_formatting": chat.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_license_scan": licenses.ORACLE,
        "op10_quality_rules": quality.ORACLE,
        "op11_filter_interactions": filters.ORACLE,
        "op13_ranked_search": ranking.ORACLE,
        "quality_policies": quality.POLICIES_ORACLE,
        "quality_ablation": quality.ABLATION_ORACLE,
    }
