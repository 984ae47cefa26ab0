"""Tunable parameters of retrieval and ingest, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    bm25_top_k: int = 30
    dense_top_k: int = 30
    rrf_k: int = 60
    rerank_top_n: int = 20
    final_top_k: int = 5
    use_reranker: bool = True
    max_replan_iters: int = 3
    summary_threshold: int = 12
    history_window: int = 6
    prompt_history: int = 4
    chunk_max_chars: int = 1000
    chunk_overlap: int = 200
    max_upload_size: int = 5 * 1024 * 1024
    stale_minutes: int = 10
    max_subquestions: int = 4
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        """From text values: a bool is true for 1, true, yes, on; a number that can't be read keeps its default."""
        got = {}
        for f in fields(cls):
            raw = values.get(f.name.upper(), values.get(f.name))
            if raw is None:
                continue
            if f.type == "bool":
                got[f.name] = str(raw).strip().lower() in {"1", "true", "yes", "on"}
            else:
                try:
                    got[f.name] = (int if f.type == "int" else float)(raw)
                except ValueError:
                    pass
        return cls(**got)
