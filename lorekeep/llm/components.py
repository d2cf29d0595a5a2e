"""Connected components of an edge table, as the similarity joins use them."""

from __future__ import annotations

from ..operators.components import MAX_ROUNDS, components

__all__ = ["MAX_ROUNDS", "components"]
