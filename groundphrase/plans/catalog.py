"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from groundphrase.plans import evaluation, files, fuzzy, intents, mentions, planning, retrieval, states, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (texts, intents, retrieval, states, planning, evaluation, fuzzy, mentions, files):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
