"""Corpus pipeline: quality rules, MinHash near-dedup, secret scans, packing."""

from __future__ import annotations

from quillspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
