"""A stream source that asks a Python function for rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, poll: Callable[[int], tuple[list[tuple], int]]):
        self.poll = poll

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = self.poll(start["at"])  # an error of the producer fails the stream; it never ends it quietly
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self.poll(start["at"])
        return iter(rows[: end["at"] - start["at"]])

    def commit(self, end: dict) -> None:
        pass


def PollingSource(name_: str, schema_: str, poll: Callable[[int], tuple[list[tuple], int]]) -> type[DataSource]:  # noqa: N802
    """A data source class to be registered: poll(at) gives the rows from offset `at` on and the next offset, which
    counts rows.  poll must give the same rows for the same offset, so a lost batch can be read again."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ARG002
            return _Reader(poll)

    return Source
