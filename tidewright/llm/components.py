"""Connected components by randomised contraction."""

from __future__ import annotations

from tidewright.operators.graph import linked as components

__all__ = ["components"]
