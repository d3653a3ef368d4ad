"""All queries of the core, by name."""

from __future__ import annotations

from . import grounding, hierarchy, references, relations, retrieval, selection, sequences, streams, text

_MODULES = [references, hierarchy, text, retrieval, relations, sequences, grounding, streams, selection]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = retrieval.bm25_topk
