"""Registration of queries and their SQL within a plan module."""

from __future__ import annotations

from tidemark.functions.columns import NUDGE


def collector():
    """(queries, oracles, decorator) of a module; SQL gets the same nudge before rounding as ``tidy``."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql:
                nudged = f" + {NUDGE:.10f}, 4) + 0.0"
                oracles[name] = sql.replace(nudged, ", 4) + 0.0").replace(", 4) + 0.0", nudged)  # SQL of other queries within is nudged already
            return f

        return add

    return queries, oracles, query
