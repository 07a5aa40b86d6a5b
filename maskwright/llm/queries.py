"""The queries of this folder and the SQL that they are held against."""

from __future__ import annotations

import importlib

#: Query name -> module of this folder; each module has query(spark, sf_dir) and may have ORACLE_SQL.
MODULES = {
    "op1_quality_divergence": "op1_quality",
    "op2_benchmark_containment": "op2_decontaminate",
    "op3_pii_disclosure": "op3_pii",
    "op4_licence_sentences": "op4_licences",
    "op5_residual_packing": "op5_packing",
    "op6_warc_revisits": "op6_warc",
    "op7_reply_trees": "op7_chat",
    "op8_attention_quality": "op8_quality_mil",
    "op9_attention_lm": "op9_lm",
    "op10_simhash_trie": "op10_simhash",
}


def queries() -> dict:
    return {name: importlib.import_module(f"maskwright.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"maskwright.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
