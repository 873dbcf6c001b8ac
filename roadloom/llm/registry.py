"""The subpackage's queries and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("op1_itq", "op10_surrogates", "op11_anagrams", "op12_winnowing", "op13_divergence", "op2_licenses", "op3_token_counts", "op4_secret_links", "op5_byte_bpe", "op6_raking", "op7_host_rules", "op8_simhash", "op9_hilbert")
for _m in MODULES:
    _module = import_module(f"roadloom.llm.{_m}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
