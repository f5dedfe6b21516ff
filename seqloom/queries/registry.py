"""Registration of queries with their SQL."""

from __future__ import annotations


def registry():
    """``QUERIES, SQL, query``: two dictionaries and the decorator that fills them."""
    queries, sqls = {}, {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return add

    return queries, sqls, query
