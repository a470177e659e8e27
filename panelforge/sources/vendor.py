"""Vendor connectors as Python data sources.

``register(spark, name, fetch, schema, slices)`` makes ``spark.read.format(name).load()`` pull one input partition a slice; the slice
contract says what a partition is: BY_DATE, BY_SYMBOL or BY_PANEL.  ``fetch(slice, offset, limit)`` returns rows as tuples
and is paged until a short page; a failing page is tried again.  No network client is part of this library.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from enum import Enum

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(Enum):
    BY_DATE = "date"
    BY_SYMBOL = "symbol"
    BY_PANEL = "panel"


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


def register(spark: SparkSession, name_: str, fetch: Callable, schema_: str, slices: Iterable, page: int = 5000, tries: int = 3, pause: float = 0.5) -> None:
    items = list(slices)

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(x) for x in items] or [_Part(None)]

        def read(self, part):
            if part.value is None:
                return
            offset = 0
            while True:
                for k in range(tries):
                    try:
                        rows = list(fetch(part.value, offset, page))
                        break
                    except OSError:
                        if k == tries - 1:
                            raise
                        time.sleep(pause * 2**k)
                yield from rows
                if len(rows) < page:
                    return
                offset += page

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema_

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)


def plan(kind: Slice, dates: list, symbols: list, width: int = 100) -> list:
    """Slices of a pull: single dates, single symbols, or blocks of symbols over the whole range."""
    if kind is Slice.BY_DATE:
        return list(dates)
    if kind is Slice.BY_SYMBOL:
        return list(symbols)
    return [tuple(symbols[i : i + width]) for i in range(0, len(symbols), width)]
