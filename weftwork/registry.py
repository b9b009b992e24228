"""Every registered query of the library itself, with the SQL that checks it."""

from __future__ import annotations

from .queries import modules, styles, tables

FLAGSHIP = "page_atomic_rules"
QUERIES: dict = {**styles.QUERIES, **modules.QUERIES, **tables.QUERIES}
ORACLE_SQL: dict[str, str] = {**styles.ORACLE_SQL, **modules.ORACLE_SQL, **tables.ORACLE_SQL}
