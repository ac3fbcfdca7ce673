"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from . import q_agents, q_exports, q_flows, q_matching, q_pages, q_prompts, q_scalars, q_sequences, q_stores  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
