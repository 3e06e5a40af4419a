"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from sparktape.llm import (
    angular, bitplanes, decontaminate, factorisation, licences, mixing, pagecrf, perplexity, simhash, stringkernel, tokencount, toxicity, warc,
)


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontaminate.op1,
        "op2_mix_sources": mixing.op2,
        "op3_token_counts": tokencount.op3,
        "op4_warc": warc.op4,
        "op5_simhash_near_dedup": simhash.op5,
        "op6_quality_classifier": factorisation.op6,
        "op7_quality_rules": perplexity.op7,
        "op8_toxicity": toxicity.op8,
        "op9_language_id": stringkernel.op9,
        "op10_license_scan": licences.op10,
        "op11_centroid_clustering": bitplanes.op11,
        "op12_hard_negatives": angular.op12,
        "op13_html_extraction": pagecrf.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": decontaminate.OP1_SQL,
        "op2_mix_sources": mixing.OP2_SQL,
        "op4_warc": warc.OP4_SQL,
        "op11_centroid_clustering": bitplanes.OP11_SQL,
        "op12_hard_negatives": angular.OP12_SQL,
    }
