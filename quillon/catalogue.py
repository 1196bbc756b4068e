"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from quillon.plans import content, legal, requests, retrieval

_MODULES = [retrieval, content, requests, legal]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
