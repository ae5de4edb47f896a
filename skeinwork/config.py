"""Settings of the engine, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass

STRATEGIES = ("vector", "graph", "hybrid", "adaptive")
INTENTS = ("entity_lookup", "relationship", "aggregation", "temporal", "comparison", "exploration", "factual")


@dataclass(frozen=True)
class EngineConfig:
    chunk_strategy: str = "csv_row"
    chunk_size: int = 500
    chunk_overlap: int = 50
    window_size: int = 100
    min_confidence: float = 0.5
    embedding_dim: int = 384
    top_k: int = 10
    max_depth: int = 2
    path_limit: int = 50
    score_mode: str = "distance"
    depth_mode: str = "bfs"
    max_tokens: int = 4000

    def __post_init__(self):
        if self.score_mode not in ("distance", "similarity"):
            raise ValueError(f"unknown score_mode {self.score_mode!r}")
        if self.depth_mode not in ("compat", "bfs"):
            raise ValueError(f"unknown depth_mode {self.depth_mode!r}")
