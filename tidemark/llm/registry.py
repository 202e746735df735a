"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import ann, bpe, chat_format, html_extract, jaccard_join, lm_score, mixing, quality_rules, suffix_dedup, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_bpe": bpe.op4_bpe,
    "op5_ann": ann.op5_ann,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_mixing": mixing.op10_mixing,
}

SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_jaccard_join": jaccard_join.OP2_SQL,
    "op3_chat_format": chat_format.OP3_SQL,
    "op8_lm_score": lm_score.OP8_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
