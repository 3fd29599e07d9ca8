"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import bpe, filter_audit, hpylm, line_dedup, mixing, packing, quality, sharding, simhash, substring, topk, toxicity, whitening

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_simhash": simhash.op2_simhash,
    "op3_substring": substring.op3_substring,
    "op4_packing": packing.op4_packing,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_lm_scoring": hpylm.op8_lm_scoring,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_bpe": bpe.op13_bpe,
}

ORACLE_SQL = {
    "op1_topk": topk.OP1_SQL,
    "op3_substring": substring.OP3_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
