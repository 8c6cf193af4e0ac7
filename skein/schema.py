"""Table schemas, enumerations, small dimensions and configuration defaults."""

from __future__ import annotations

from dataclasses import dataclass

DOCUMENT_STATUS = ("pending", "chunking", "embedding", "done", "failed", "archived")
CHUNK_STATUS = ("pending", "embedding", "done", "failed")
TASK_TYPES = ("parse_pdf", "chunk_document", "embed_chunk", "insert_vector")
TASK_STATUS = ("pending", "processing", "done", "failed", "retrying")
DOCUMENT_TYPES = ("pdf", "text", "url")
HEALTH = ("healthy", "degraded", "unhealthy")

#: Model, dimensions, price per million tokens.
EMBEDDING_MODELS = (("text-embedding-3-large", 3072, 0.13), ("text-embedding-3-small", 1536, 0.02), ("text-embedding-ada-002", 1536, 0.10))
DEFAULT_PRICE, DEFAULT_DIMENSION = 0.10, 1536


#: Schemas as DDL, so that Python workers can import them without a session.
TABLES: dict[str, str] = {
    "rag_documents": "id string, source_uri string, content_hash binary, status string, document_type string, attributes map<string,string>, error_message string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "rag_chunks": "id string, document_id string, chunk_index int, content string, content_hash binary, status string, tokens int, attributes struct<start_char:int,end_char:int,page_num:int,context:string>, created_at timestamp, updated_at timestamp",
    "rag_embeddings": "id string, chunk_id string, text string, embedding array<float>, model string, tokens_used int, cost_usd double, attributes map<string,string>, created_at timestamp, updated_at timestamp",
    "processing_tasks": "id string, document_id string, task_type string, status string, priority int, attempt_count int, max_attempts int, error_message string, attributes map<string,string>, worker_id string, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "task_deadletter": "id string, task_id string, document_id string, reason string, error_details string, created_at timestamp",
}


@dataclass(frozen=True)
class ChunkConfig:
    """How texts are chunked. Overlap is checked but has no effect."""

    size: int = 1024
    overlap: int = 0
    least: int = 50
    most_chunks: int = 10_000

    def __post_init__(self):
        if self.size < self.least:
            raise ValueError("size must not be below least")
        if self.overlap > self.size // 2:
            raise ValueError("overlap must not exceed half the size")


@dataclass(frozen=True)
class QualityConfig:
    """Bounds on chunks: tokens, characters, share of meaningful characters, similarity of near duplicates."""

    tokens: tuple[int, int] = (10, 2048)
    chars: tuple[int, int] = (50, 8192)
    meaningful: float = 0.5
    similarity: str = "0.95"


@dataclass(frozen=True)
class LimiterConfig:
    requests_per_minute: int = 3000
    tokens_per_minute: int = 1_500_000
    burst: int = 1000

    @property
    def refill_per_second(self) -> float:
        return min(self.requests_per_minute, self.tokens_per_minute) / 60


@dataclass(frozen=True)
class BackoffConfig:
    initial: float = 1.0
    most: float = 300.0
    base: float = 2.0


@dataclass(frozen=True)
class BreakerConfig:
    failures: int = 5
    recovery_seconds: float = 60.0
    trials: int = 3
    successes: int = 2
