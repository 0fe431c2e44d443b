"""All registered queries over the driver tables, and the SQL that checks them."""

from __future__ import annotations

from . import q_align, q_formats, q_graph, q_intervals, q_oriented, q_paths

_PARTS = (q_intervals, q_align, q_graph, q_paths, q_formats, q_oriented)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.ORACLES.items()}
