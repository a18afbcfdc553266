"""The subpackage's queries and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import bpe, brown, chat, decontaminate, langid, licenses, quality, sharding, simhash, substrings

MODULES = (licenses, decontaminate, simhash, chat, substrings, langid, brown, bpe, quality, sharding)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
