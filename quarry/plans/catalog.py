"""Import every plan module so its queries register, then expose them."""

from __future__ import annotations

from quarry.plans import (  # noqa: F401
    answering,
    corpus,
    dialog,
    events,
    landing,
    retrieval,
    training,
    web,
)
from quarry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
