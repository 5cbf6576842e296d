"""Imports every query module, which fills the registry."""

from . import annotations, cache, episodes, frames, metrics, projections, sampling, similarity  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
