"""Registered queries and their SQL."""

from __future__ import annotations

from timberline.plans import derived as D

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{e}", D.EVENTS_SQL)
        return f

    return add
