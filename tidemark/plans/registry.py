"""Query registry: key -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under key, with its SQL if there is any."""

    def put(f):
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


from . import basic, composed, loops  # noqa: E402, F401  the modules register their queries
