"""All queries of the llm subpackage."""

from __future__ import annotations

from sparmat.llm import queries_algorithms, queries_texts

MODULES = (queries_algorithms, queries_texts)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
