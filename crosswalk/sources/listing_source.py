"""A listing that comes in pages as a data source of Spark: its pages are partitions, read side by side.

``spark.dataSource.register(PagedListing)``, then ``spark.read.format("paged_listing").option("url", "https://.../items?page={page}&size={size}").schema("id long, ...").load()``.
Page 0 says how many pages there are (``totalPages``); where it doesn't, one partition asks for page after page until one says that it is the last.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Pages(InputPartition):
    """Pages from ``first`` to before ``end``; without an end, until the last."""

    first: int
    end: int | None


class PagedListing(DataSource):
    """Options: url with {page} and {size}; size (100), tries (3), wait seconds between them (2), together (pages of a partition, 1), and filters (false): whether the listing
    is asked for equal texts only, which needs ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("filters") == "true" else ListingReader)(self.options, schema)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.url, self.size, self.tries, self.wait, self.together = options["url"], int(options.get("size", 100)), int(options.get("tries", 3)), float(options.get("wait", 2)), int(options.get("together", 1))
        self.fields, self.equal = schema.fieldNames(), {}

    def fetch(self, page: int) -> dict:
        from urllib.parse import quote

        url = self.url.format(page=page, size=self.size) + "".join(f"&{quote(k)}={quote(v)}" for k, v in self.equal.items())
        for left in range(self.tries - 1, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 - the caller names the address
                    return json.load(r)
            except Exception:
                if not left:
                    raise
                time.sleep(self.wait)
        raise AssertionError

    def partitions(self) -> list[InputPartition]:
        pages = self.fetch(0).get("totalPages")
        if pages is None:
            return [Pages(0, None)]
        return [Pages(a, min(a + self.together, pages)) for a in range(0, pages, self.together)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page, last = partition.first, False
        while not last and (partition.end is None or page < partition.end):
            got = self.fetch(page)
            for x in got.get("content", []):
                yield tuple(json.dumps(x) if f == "json" else x.get(f) for f in self.fields)
            last, page = partition.end is None and bool(got.get("last", True)), page + 1


class FilteredReader(ListingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of text go to the listing as parameters of the address; Spark applies all filters besides, as a listing may not know a parameter."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str):
                self.equal[f.attribute[0]] = f.value
            yield f
