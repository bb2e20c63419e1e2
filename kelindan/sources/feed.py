"""A paged feed as a streaming source: the page number is the offset, so a restart goes on after the last page. Pages are landed files
``<folder>/<outlet>/page=<n>.html``; what lands them is not part of this library."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class LandedFeed(DataSource):
    """Options: ``path``, ``outlet``, ``pages_per_batch`` (default 10)."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return "outlet string, page int, origin string, html string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Pages(self.options)


class _Pages(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = os.path.join(options["path"], options["outlet"])
        self.outlet, self.most = options["outlet"], int(options.get("pages_per_batch", "10"))

    def initialOffset(self) -> dict:
        return {"page": 1}

    def _page(self, n: int) -> tuple | None:
        file = os.path.join(self.folder, f"page={n}.html")
        if not os.path.exists(file):
            return None
        with open(file, encoding="utf-8") as f:
            return (self.outlet, n, file, f.read())

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, n = [], start["page"]
        while len(rows) < self.most and (row := self._page(n)):
            rows.append(row)
            n += 1
        return iter(rows), {"page": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([row for n in range(start["page"], end["page"]) if (row := self._page(n))])
