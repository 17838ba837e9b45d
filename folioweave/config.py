"""Settings of the two retrieval pipelines and of indexing, with the reference's defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Indexing:
    window: int = 1200
    overlap: int = 100
    min_sentences: int = 3
    max_sentences: int = 20
    soft_threshold: float = 0.1
    max_clusters: int = 50
    reduced_dim: int = 10
    stop_nodes: int = 5
    prompt_chars: int = 8000
    vector_dim: int = 96


@dataclass(frozen=True)
class Adaptive:
    """C1: adaptive retrieval."""

    max_chunks: int = 25
    shortest_path_k: int = 4
    dense_pool: int = 50


@dataclass(frozen=True)
class Region:
    """C2: region retrieval. `max_hops` is honoured; one hop is the default."""

    top_m: int = 10
    search_factor: int = 10
    seed_fallback: int = 3
    max_hops: int = 1
    mentions_per_entity: int = 10
    candidate_pool: int = 50
    final_k: int = 10
    min_seeds: int = 1
    min_candidates: int = 3
    strict_reference_ids: bool = False
