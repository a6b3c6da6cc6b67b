"""Import every operator module so its query registers."""

from __future__ import annotations

from quarry.llm import (  # noqa: F401
    exact_dedup,
    fim,
    minhash,
    mixing,
    fingerprints,
    packing,
    quality,
    repair,
    secrets,
    sharding,
    suffixes,
    token_counts,
    wrappers,
)
from quarry.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
