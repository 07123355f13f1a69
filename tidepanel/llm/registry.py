"""Queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from tidepanel.llm import byte_bpe, exact_dedup, hard_negatives, html_extract, jaccard_join, language_id, mixing, pieces, pii, quality_rules, repeats, resampling, warc


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "quality_ablations": quality_rules.quality_ablations,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_language_id": language_id.op4_language_id,
        "op5_sentencepiece": pieces.op5_sentencepiece,
        "op6_mixing": mixing.op6_mixing,
        "op8_pii": pii.op8_pii,
        "op7_repeats": repeats.op7_repeats,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_warc": warc.op10_warc,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_importance_resampling": resampling.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_quality_rules": quality_rules.ORACLE,
        "quality_ablations": quality_rules.ABLATIONS_ORACLE,
        "op9_jaccard_join": jaccard_join.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
    }
