"""All queries outside the llm subpackage."""

from __future__ import annotations

from sparmat.plans import core_problems, q_extras, q_genome, q_graph, q_matrix, q_methods, q_ranks, q_relational, q_sources, q_streaming

MODULES = (core_problems, q_extras, q_genome, q_graph, q_matrix, q_methods, q_ranks, q_relational, q_sources, q_streaming)
FLAGSHIP = "pseudobulk"


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
