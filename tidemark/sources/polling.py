"""A polled source as a Spark data source: batch and stream, with retries and an id cursor.

``fetch(after)`` is any picklable function that returns (rows of JSON text, new cursor); the
network code stays outside, so tests and replays pass a function over files. Rows after a cursor
must keep their order: a batch that is read again after a failure asks for the rows after its
begin and keeps as many as it had, so it holds the same rows whatever has come since.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

Fetch = Callable[[int], tuple[list[str], int]]


def with_backoff(fetch: Fetch, after: int, attempts: int = 5, first: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[list[str], int]:
    """Call fetch, waiting twice as long after each failure, up to ``most``."""
    wait = first
    for attempt in range(attempts):
        try:
            return fetch(after)
        except OSError:
            if attempt == attempts - 1:
                raise
            sleep(wait)
            wait = min(most, 2 * wait)
    raise AssertionError("unreachable")


def polled_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A data source class to register with ``spark.dataSource.register``; its column is ``value``."""

    class Reader(DataSourceReader):
        def read(self, partition) -> Iterator[tuple]:
            for row in with_backoff(fetch, 0)[0]:
                yield (row,)

    class StreamReader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"after": 0, "rows": 0}

        def read(self, start: dict):
            rows, after = with_backoff(fetch, start["after"])
            return iter([(r,) for r in rows]), {"after": after, "rows": len(rows)}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            rows, _ = with_backoff(fetch, start["after"])
            if len(rows) < end["rows"]:
                raise OSError(f"{end['rows']} rows were read after {start['after']}, {len(rows)} are there now")
            return iter([(r,) for r in rows[: end["rows"]]])

        def commit(self, end: dict) -> None:
            """Nothing to acknowledge: the cursor is in Spark's checkpoint."""

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "value string"

        def reader(self, schema):
            return Reader()

        def simpleStreamReader(self, schema):
            return StreamReader()

    return Polled
