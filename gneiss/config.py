"""Every threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunking
    max_chunk_chars: int = 3000
    min_chunk_chars: int = 4
    max_heading_chars: int = 90
    min_heading_words: int = 2
    min_heading_letters: int = 6
    min_uppercase_ratio: float = 0.75
    min_table_rows: int = 3
    min_numeric_cells: int = 3
    min_table_width: int = 2
    title_budget: int = 180
    title_chars: int = 250
    # retrieval
    k1: float = 1.5
    b: float = 0.75
    section_weight: float = 2.0
    min_gate: int = 2
    min_coverage: float = 0.6
    max_distance: float = 0.60
    veto_distance: float = 0.80
    rrf_k: int = 60
    per_section: int = 2
    evidence: int = 3
    candidates: int = 10
    # answers
    answer_chars: int = 300
    excerpt_chars: int = 500


DEFAULTS = Settings()
