"""The subpackage's queries and their SQL."""

from __future__ import annotations

import importlib

#: module -> queries of that name in it; an operator's own SQL is its module's ORACLE_SQL.
MODULES = {
    "op4_token_stream": "op4_token_stream",
    "op1_quality_rules": "op1_quality_rules",
    "op2_pii": "op2_pii",
    "op3_quality_classifier": "op3_quality_classifier",
    "op6_toxicity": "op6_toxicity",
    "op5_lsh_forest": "op5_lsh_forest",
    "op7_warc": "op7_warc",
    "op8_rlz_dedup": "op8_rlz_dedup",
    "op9_decontamination": "op9_decontamination",
    "op10_packing": "op10_packing",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"runnel.llm.{m}"), name) for m, name in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"runnel.llm.{m}"), "ORACLE_SQL", None) for m, name in MODULES.items()}
    return {k: v for k, v in found.items() if v}
