"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query name -> module of this package that has a function of that name and, where SQL can express it, SQL.
_MODULES = {
    "op1_kneser_ney": "kneser_ney",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_quality_rules": "quality_rules",
    "op4_telephony": "telephony",
    "op5_packing": "packing",
    "op6_line_dedup": "line_dedup",
    "op7_sharding": "sharding",
    "op8_ngram_join": "ngram_join",
    "op9_mixing": "mixing",
    "op10_licences": "licences",
    "op11_filter_audit": "filter_audit",
    "op12_whitening": "whitening",
    "op13_sentencepiece": "sentencepieces",
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{_MODULES[name]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: _module(name).SQL for name in _MODULES if hasattr(_module(name), "SQL")}
