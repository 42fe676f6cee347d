"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its own name, with its SQL where SQL can express it; a name can be taken once."""

    def register(function):
        if function.__name__ in QUERIES:
            raise ValueError(f"two queries are called {function.__name__}")
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register
