"""Parameters and schemas of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "hierarchical"
    chunk_size: int = 512
    overlap: int = 128
    min_chunk: int = 50

    def __post_init__(self):
        if not self.strategy:
            raise ValueError("a chunking strategy must be named")
        if self.chunk_size <= 0 or self.overlap < 0 or self.min_chunk < 0:
            raise ValueError("chunk_size must be positive, overlap and min_chunk not negative")


@dataclass(frozen=True)
class RetrievalConfig:
    vector_top_k: int = 20
    bm25_top_k: int = 20
    final_top_k: int = 8
    rrf_k: int = 60
    rerank_threshold: float = 0.45
    similarity_threshold: float = 0.0


@dataclass(frozen=True)
class VectorIndexConfig:
    """IVF parameters; graph indexes have no counterpart in a distributed scan."""

    dim: int = 1536
    lists: int = 100
    probes: int = 10
    ttl_days: int = 0
    partition_key: str | None = None


SEGMENTS = "doc_id string, seg_idx int, seg_id string, content string, content_type string, page_num int, section_title string, heading_level int, table_markdown string, metadata map<string,string>"
CHUNKS = "chunk_id string, doc_id string, chunk_index int, content string, content_type string, segment_ids array<string>, page_num int, section_title string, heading_level int"
SYNC_MESSAGE = "docId string, docName string, tenantId string, action string, storedPath string, md5 string, timestamp long"
REQUEST = "question string, topK int, vectorTopK int, bm25TopK int, enableHallucinationCheck boolean, tenantId string"
EVAL_REQUEST = "samples array<struct<question: string, relevantChunkIds: array<string>, expectedAnswer: string>>, topK int"
SNAPSHOT = "snapshotId string, provenance string, topK int, rankConstant int, queries array<struct<question: string, category: string, relevantChunkIds: array<string>, vector: array<string>, bm25: array<string>>>"
