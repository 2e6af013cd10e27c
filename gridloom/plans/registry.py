"""All registered queries of the table operators, and their DuckDB SQL."""

from __future__ import annotations

from . import documents, files, gates, scoring, series, texts, varied

_PARTS = (scoring, texts, series, documents, gates, files, varied)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
