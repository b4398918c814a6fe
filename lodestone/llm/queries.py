"""All queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from lodestone.llm import chat, lines, mixing, neighbours, ngrams, packing, quality, repeats, search, sharding

_MODULES = (repeats, packing, neighbours, sharding, mixing, chat, quality, search, ngrams, lines)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
