"""A Python data source for paper metadata from any lookup function, with ids pushed down to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "paper_id string, categories array<string>, source_url string"


class _Ids(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        super().__init__(ids)
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, ids: list[str], lookup: Callable, size: int) -> None:
        self.ids, self.lookup, self.size = ids, lookup, size

    def partitions(self):
        return [_Ids(self.ids[i:i + self.size]) for i in range(0, len(self.ids), self.size)] or [_Ids([])]

    def read(self, partition):
        for paper in partition.ids:
            found = self.lookup(paper)
            if found is not None:  # unknown papers are left out
                yield paper, list(found[0]), found[1]


def metadata_source(lookup: Callable[[str], tuple[list[str], str | None] | None], name: str = "paper_metadata") -> type[DataSource]:
    """A source class to register: ``spark.read.format(name).option("ids", "a,b").load()``."""

    class PaperMetadata(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            ids = [i for i in self.options.get("ids", "").split(",") if i]
            return _Reader(ids, lookup, int(self.options.get("batch", "100")))

    return PaperMetadata
