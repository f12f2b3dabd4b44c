"""A data source for crawl items: one partition per start address."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_items(address: str) -> Iterator[tuple[str | None, str | None]]:
    """Items of a saved crawl: a file of JSON lines with url and text.  Stands in for a live crawler."""
    with Path(address.removeprefix("file://")).open(encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                item = json.loads(line)
                yield item.get("url"), item.get("text")


class CrawlSource(DataSource):
    """Options: ``startUrls`` (JSON list of addresses) and ``fetch``, ``module:function`` from an address to (url, text) pairs."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "url string, text string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return CrawlReader(dict(self.options))


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = json.loads(options.get("starturls") or options.get("startUrls") or "[]")
        self.fetch = options.get("fetch") or f"{__name__}:read_items"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str | None, str | None]]:
        if partition is None or partition.value is None:
            return
        module, _, function = self.fetch.partition(":")
        yield from getattr(importlib.import_module(module), function)(partition.value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CrawlSource)
