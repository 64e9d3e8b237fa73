"""The registered queries of the training-data operators: opN_<name> and the pipeline."""

from __future__ import annotations

from terrace.llm import bpe, conversations, decontaminate, exact_dedup, language, line_templates, lm_score, neighbours, ngram_join, pii, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_pii": pii.op1,
        "op2_decontamination": decontaminate.op2,
        "op3_url_filter": url_filter.op3,
        "op4_lm_score": lm_score.op4,
        "op5_exact_dedup": exact_dedup.op5,
        "op6_line_templates": line_templates.op6,
        "op7_ngram_join": ngram_join.op7,
        "op8_byte_bpe": bpe.op8,
        "op9_language_id": language.op9,
        "op10_toxicity": toxicity.op10,
        "op11_conversation_repair": conversations.op11,
        "op12_neighbours": neighbours.op12,
        "op13_whitening": whitening.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.OP2_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op6_line_templates": line_templates.OP6_SQL,
    }
