"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Module: names of its queries, in the order of the problems.
MODULES = {
    "ranking": ["p4_found", "p4_ranking"],
    "neighbours": ["p5_found", "p5_nearest"],
    "markup": ["p1_found", "p1_clean", "p1_templates", "p1_slots"],
    "splitting": ["p3_found", "p3_pieces"],
    "mojibake": ["p7_found", "p7_repaired"],
    "near_duplicates": ["p6_found", "p6_groups"],
    "leaks": ["p9_found", "p9_matches"],
    "tokenizer": ["p8_ids"],
    "spam": ["p10_found", "p10_scores"],
}


def queries() -> dict:
    return {n: getattr(import_module(f"recall_engine.llm.{m}"), n) for m, names in MODULES.items() for n in names}


def oracle_sql() -> dict[str, str]:
    from recall_engine.llm.oracles import ORACLES

    return dict(ORACLES)
