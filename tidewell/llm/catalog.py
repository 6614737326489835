"""Registered queries of this folder."""

from __future__ import annotations

from tidewell.llm import op1_html, op2_packing, op3_token_counts, op4_substrings, op5_minhash, op6_quality, op7_language
from tidewell.llm import op8_secrets, op9_decontamination, op10_warc, op11_exact_dedup, op12_whitening, op13_fill_in_middle

MODULES = {m.__name__.rpartition(".")[2]: m for m in (op1_html, op2_packing, op3_token_counts, op4_substrings, op5_minhash, op6_quality, op7_language, op8_secrets, op9_decontamination, op10_warc, op11_exact_dedup, op12_whitening, op13_fill_in_middle)}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
