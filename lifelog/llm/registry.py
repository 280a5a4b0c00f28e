"""Queries of this package and the SQL that states their results."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixture", "simhash", "pii", "sentencepiece", "language", "fertility", "quality", "spotsigs", "licenses", "tool_calls", "winnowing", "fim", "whitening")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"lifelog.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
