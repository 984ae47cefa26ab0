"""All registered queries outside the llm subpackage."""

from __future__ import annotations

from quillspark.plans import agent, layout, references, retrieval, state, store, streams, texts

MODULES = [references, retrieval, agent, state, texts, layout, streams, store]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
