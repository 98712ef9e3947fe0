"""The queries of this subpackage, their SQL, and the modules that hold them."""

from __future__ import annotations

from importlib import import_module

OPERATORS = [
    "preferences",
    "toxicity",
    "bpe",
    "quality",
    "topk",
    "simhash",
    "suffix_array",
    "url_cascade",
    "exact_dedup",
    "mixing",
]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in OPERATORS:
    _m = import_module(f"fathom.llm.{_name}")
    QUERIES[_m.NAME] = _m.query
    if _m.SQL is not None:
        ORACLES[_m.NAME] = _m.SQL
