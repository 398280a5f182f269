"""Operators for preparing training data. Nothing else in the library imports this package."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries, in the order of the operators.
MODULES = ["near_dup", "token_count", "chat", "top_k", "bpe", "language", "decontam", "line_dedup", "url_filters", "quality"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"tolmark.llm.{name}").QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"tolmark.llm.{name}").ORACLES)
    return out
