"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_tokeniser_fertility": ("fertility", "op1"),
    "op2_projection_forest": ("projection_forest", "op2"),
    "op3_bpe": ("bpe", "op3"),
    "op4_quotation_linking": ("quotes", "op4"),
    "op5_raking": ("raking", "op5"),
    "op6_suffix_array_dedup": ("suffix_dedup", "op6"),
    "op7_kneser_ney_quality": ("kneser_ney", "op7"),
    "op8_substring_dedup": ("automaton_dedup", "op8"),
    "op9_backoff_automaton": ("backoff_automaton", "op9"),
    "op10_dart_minhash": ("dart_minhash", "op10"),
    "op11_position_crc": ("position_crc", "op11"),
    "op12_periodic_runs": ("periodic_runs", "op12"),
    "op13_exact_packing": ("exact_packing", "op13"),
}

QUERIES = {name: getattr(importlib.import_module(f"trapline.llm.{module}"), fn) for name, (module, fn) in _MODULES.items()}
ORACLES: dict[str, str] = {"op5_raking": importlib.import_module("trapline.llm.raking").oracle(),
                           "op11_position_crc": importlib.import_module("trapline.llm.position_crc").oracle()}
