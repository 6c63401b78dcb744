"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sentencepiece_codec", "quality", "simhash", "media", "warc", "secret_scan", "html_text", "toxicity", "packing", "license_scan", "centroids", "conversation_repair", "personal_data")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"groundphrase.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
