"""Every knob of the library in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # --- chunking; fixed values: the merge limit is half of a 512-token chunk
    heading_tag: str = "h2"
    merge_tokens: int = 256
    chunk_tokens: int = 512
    overlap_tokens: int = 50
    min_tokens: int = 20

    # --- retrieval; fixed values: 20 hits per query, score cut 0.7, 5 after reranking
    k: int = 20
    score_threshold: float = 0.7
    rerank_top: int = 5

    # --- scoring of the built-in lexical search
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    embed_dim: int = 64
    lsh_bands: int = 16
    lsh_bits: int = 8
    vector_weight: float = 0.5
    rrf_constant: int = 60

    # --- question handling of the built-in defaults
    route_min_known: float = 0.5
    rewrite_keywords: int = 5
    rewrite_max_share: float = 0.5  # of the corpus; commoner words are left out of a rewrite
    hyde_docs: int = 3
    hyde_terms: int = 10
    trim_variants: bool = False

    # --- built-in judges
    correct_f1: float = 0.5
    sufficient_recall: float = 0.6
    grounded_share: float = 0.8

    # --- physical bounds
    # A query set is broadcast while it stays under both bounds; a larger one takes the grid join.
    broadcast_queries: int = 100_000
    broadcast_bytes: int = 128 << 20
    broadcast_hits: int = 1_000_000  # hits, or rows with a hash each, that are broadcast to a join
    scan_queries: int = 4096         # keyword searches up to which every task returns hits of its own
    # Rows one grid cell may hold on its index side and on its query side.
    cell_rows: int = 20_000
    cell_queries: int = 20_000
    # Doubles in one scoring tile (queries x rows).
    tile_cells: int = 4_000_000
    seed_rows: int = 1024            # longest passages that `leakage` holds every answer against first

    # --- search structures that a search reads in part
    part_rows: int = 65_536          # rows whose postings share a folder
    shard_rows: int = 512            # rows of one shard; a block holds a term's postings in one
    page_postings: int = 256         # postings that are written in one row, about
    run_terms: int = 1 << 20         # terms that a task makes blocks of at once, about
    posting_group_bytes: int = 4 << 20
    posting_skip_rows: int = 100     # written rows that a parquet reader skips at once by their bounds
    seed_shards: int = 4             # shards that each query scores before the others' bounds are held against it
    pushed_terms: int = 256          # up to so many words are named to the parquet reader
    cell_sample: int = 50_000        # rows that the centroids are fitted on, about
    most_cells: int = 4096
    cell_rounds: int = 8
    cell_queries_measured: int = 200
    target_recall: float = 0.95
    exact_probes: int = 4            # cells an exact search looks into before it asks which others can matter
    lookup_ids: int = 200_000        # hits up to which the lookup table is read by ranges of ids
    lookup_ranges: int = 64
    lookup_group_bytes: int = 1 << 20
