"""Seams for live fetchers: a registry of sources and a Spark Python data source around a fetch function.

No network is used here; a fetcher is any function that yields raw records for one partition number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from murmurline.schemas import RAW


class CredentialsMissing(RuntimeError):
    """A source needs credentials that are not set."""


@dataclass(frozen=True)
class SourceSpec:
    """A source: its kind of records, its fetcher, what its records must have, and where their time is."""

    name: str
    kind: str
    fetch: Callable[[int, dict], Iterator[dict]]
    required: tuple[str, ...] = ()
    timestamp_field: str | None = None
    partitions: int = 1
    credentials: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def check(self, options: dict) -> None:
        missing = [c for c in self.credentials if not options.get(c)]
        if missing:
            raise CredentialsMissing(f"{self.name} needs {', '.join(missing)}")


REGISTRY: dict[str, SourceSpec] = {}


def register(spec: SourceSpec) -> SourceSpec:
    REGISTRY[spec.name] = spec
    return spec


class _Reader(DataSourceReader):
    def __init__(self, spec: SourceSpec, options: dict):
        self.spec, self.options = spec, options

    def partitions(self):
        return [InputPartition(i) for i in range(self.spec.partitions)]

    def read(self, partition):
        columns = [c.split()[0] for c in RAW[self.spec.kind].split(", ")]
        for record in self.spec.fetch(partition.value, self.options):
            if record is not None:  # items deleted at the source
                yield tuple(record.get(c) for c in columns)


def data_source(spec: SourceSpec) -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; its format name is the spec's name."""

    class Fetched(DataSource):
        @classmethod
        def name(cls):
            return spec.name

        def schema(self):
            return RAW[spec.kind]

        def reader(self, schema):
            spec.check(dict(self.options) | spec.options)
            return _Reader(spec, dict(self.options) | spec.options)

    return Fetched
