"""Settings that change results."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    chunk_target_tokens: int = 400
    chunk_overlap_tokens: int = 60
    chunk_min_tokens: int = 120
    chars_per_token: float = 3.6
    section_max_depth: int = 3
    flat_list_ratio: float = 0.7
    flat_list_min_items: int = 7
    flat_list_min_item_tokens: int = 8
    rrf_k: int = 60
    candidates: int = 50
    sparse_weight: float = 0.5
    lookup_max_matches: int = 5
    mmr_lambda: float = 0.8
    path_share: int = 3
    default_k: int = 6
    max_k: int = 20
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    dims: int = 768
    min_chars_per_page: int = 50
    search_exclude: tuple[str, ...] = ("Workflows", "Reports", ".obsidian")
    catalogue_exclude: tuple[str, ...] = ("Workflows", "Reports")
    document_suffixes: tuple[str, ...] = (".pdf",)
    documents_dir: str = "Files"
    debounce_seconds: float = 2.0
    flush_seconds: int = 60
    reconcile_seconds: int = 900

    def k(self, wanted: int | None) -> int:
        """A result size: none or 0 is the default, others are held within 1 and max_k."""
        return max(1, min(self.max_k, wanted or self.default_k))

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "CORPUS_") -> EngineConfig:
        """Overrides by environment: CORPUS_DIMS=256, CORPUS_SEARCH_EXCLUDE=a,b; a malformed number is an error."""
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and raw.strip():
                kind = type(f.default)
                out[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return cls(**out)


DEFAULT = EngineConfig()
