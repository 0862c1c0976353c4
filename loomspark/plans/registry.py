"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from loomspark.plans import code_text, evaluation, general, retrieval

MODULES = (retrieval, code_text, evaluation, general)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.SQL.items()}
