"""Default parameters of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FusionSettings:
    rrf_k: int = 60
    client_weights: tuple[float, float] = (1.0, 1.0)
    three_leg_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    vector_client_weights: tuple[float, float] = (0.4, 0.3)
    store_weights: tuple[float, float] = (0.5, 0.5)
    client_depth: int = 20
    vector_client_depth: int = 50
    store_depth_factor: int = 3
    sql_depth_factor: int = 2


@dataclass(frozen=True)
class SearchSettings:
    similarity_threshold: float = 0.5
    caller_threshold: float = 0.3
    max_query_chars: int = 2000
    max_top_k: int = 100
    rerank_pool_factor: int = 3
    rerank_pool_floor: int = 30
    rerank_cut: int = 5
    sparse_top_k: int = 128
    dense_dim: int = 1024
    # Query matrices above this many bytes are scanned block by block.
    query_block_bytes: int = 128 * 1024 * 1024


@dataclass(frozen=True)
class ChunkSettings:
    max_tokens: int = 512
    overlap_tokens: int = 50
    min_tokens: int = 100
    equation_min_tokens: int = 10
    include_abstract: bool = True
    include_equations: bool = True


@dataclass(frozen=True)
class ScoreSettings:
    citation_weight: float = 0.40
    recency_weight: float = 0.30
    semantic_weight: float = 0.20
    stratified_weight: float = 0.10
    recency_tau_months: float = 6.0
    semantic_threshold: float = 0.55


@dataclass(frozen=True)
class IngestSettings:
    window_days: int = 14


@dataclass(frozen=True)
class LimiterSettings:
    service_limit: int = 30
    edge_limit: int = 10
    window_seconds: int = 60


@dataclass(frozen=True)
class ChatSettings:
    context_tokens: int = 4000
    chars_per_token: int = 4
    snippet_chars: int = 500
    history_messages: int = 6
    over_fetch: int = 3


@dataclass(frozen=True)
class Settings:
    fusion: FusionSettings = field(default_factory=FusionSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    chunk: ChunkSettings = field(default_factory=ChunkSettings)
    score: ScoreSettings = field(default_factory=ScoreSettings)
    ingest: IngestSettings = field(default_factory=IngestSettings)
    limiter: LimiterSettings = field(default_factory=LimiterSettings)
    chat: ChatSettings = field(default_factory=ChatSettings)


DEFAULTS = Settings()
