"""All registered queries of the llm subpackage."""

from __future__ import annotations

from quillspark.llm import queries_conversations, queries_forms, queries_leaks, queries_neighbours, queries_sentences, queries_splitting, queries_tokens

MODULES = [queries_neighbours, queries_conversations, queries_splitting, queries_forms, queries_tokens, queries_leaks, queries_sentences]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
