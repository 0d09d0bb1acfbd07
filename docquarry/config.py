"""Driver-side settings; values become literals in the plans."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from docquarry.errors import InvalidConfiguration

# Names of the environment overrides.
ENV_CHUNK_SIZE = "RAG_CHUNK_SIZE"
ENV_CHUNK_OVERLAP = "RAG_CHUNK_OVERLAP"


@dataclass(frozen=True)
class ChunkSettings:
    """Chunk size and overlap in tokens of *token_model*."""

    size: int = 1000
    overlap: int = 200
    token_model: str = "words"
    semantic: bool = True
    preserve_headings: bool = True

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise InvalidConfiguration("chunk overlap must be >= 0 and below the chunk size")

    @classmethod
    def from_environment(cls, **defaults) -> ChunkSettings:
        """Defaults overridden by ``RAG_CHUNK_SIZE`` / ``RAG_CHUNK_OVERLAP`` when set."""
        chosen = dict(defaults)
        if ENV_CHUNK_SIZE in os.environ:
            chosen["size"] = int(os.environ[ENV_CHUNK_SIZE])
        if ENV_CHUNK_OVERLAP in os.environ:
            chosen["overlap"] = int(os.environ[ENV_CHUNK_OVERLAP])
        return cls(**chosen)


@dataclass(frozen=True)
class SearchSettings:
    k: int = 4
    metric: str = "l2"
    overfetch: int = 3
    prefilter: bool = True
    rerank: bool = False
    hybrid: bool = False
    max_context_tokens: int = 4096
    prompt_id: str = "default"
    system_prompt: str = ""


@dataclass(frozen=True)
class EngineConfig:
    """Everything an :class:`docquarry.engine.Engine` needs besides the session."""

    data_dir: str
    documents_dir: str = ""
    embedding_model: str = "sha256"
    embedding_version: str = "1"
    embedding_dim: int = 384
    model_map: dict[str, str] = field(default_factory=dict)
    chunks: ChunkSettings = field(default_factory=ChunkSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    buckets: int = 64
    embedding_attempts: int = 5
