"""Filing lists that come page by page, as a data source for batch and stream reads.

``spark.dataSource.register(PagedFilings)``, then ``spark.read.format("paged_filings")``
with the option ``path``: a folder ``<kind>/<start>-<end>/<page>.json`` of answers
(``status``, ``message``, ``total_count``, ``list``), pages counted from 1.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

FIELDS = ("corp_code", "corp_name", "stock_code", "rcept_no", "rcept_dt", "report_nm")
#: Answers of the list service: all well, nothing found (fixed values).
GOOD, NOTHING = "000", "013"
_WINDOW = re.compile(r"^(\d{8})-(\d{8})$")


@dataclass
class Pages(InputPartition):
    """Pages ``first`` to ``last`` (None: to the end) of one kind of report in one window of days."""

    kind: str
    window: str
    first: int = 1
    last: int | None = None


class _Folder:
    """The answers below a folder of any file system that Arrow can open."""

    def __init__(self, options: dict) -> None:
        if "path" not in options:
            raise ValueError("paged_filings needs the option path")
        self.path, self.skip = options["path"], options.get("onerror", "fail").lower() == "skip"

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def windows(self) -> list[tuple[str, str]]:
        from pyarrow import fs

        files, root = self._open()
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = [f.path[len(root.rstrip("/")) + 1 :].split("/") for f in found if f.type == fs.FileType.Directory]
        return sorted((n[0], n[1]) for n in names if len(n) == 2 and _WINDOW.match(n[1]))

    def count(self, kind: str, window: str) -> int:
        """How many pages lie there without a gap."""
        from pyarrow import fs

        files, root = self._open()
        names = {f.base_name for f in files.get_file_info(fs.FileSelector(f"{root}/{kind}/{window}"))}
        n = 0
        while f"{n + 1}.json" in names:
            n += 1
        return n

    def page(self, kind: str, window: str, number: int) -> dict | None:
        files, root = self._open()
        try:
            with files.open_input_stream(f"{root}/{kind}/{window}/{number}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def rows(self, part: Pages) -> Iterator[tuple]:
        """Rows of the pages in order; ends after the last page, an empty one, or as many rows as there are."""
        start, end = _WINDOW.match(part.window).groups()
        number, seen = part.first, 0
        while part.last is None or number <= part.last:
            answer = self.page(part.kind, part.window, number)
            if answer is None or answer.get("status") == NOTHING:
                return
            if answer.get("status") != GOOD:
                if self.skip:
                    return
                raise ValueError(f"{part.kind} {part.window} page {number}: {answer.get('status')} {answer.get('message')}")
            listed = answer.get("list") or []
            if not listed:
                return
            for place, item in enumerate(listed):
                yield (part.kind, start, end, number, place, *(item.get(f) for f in FIELDS))
            seen += len(listed)
            if part.last is None and seen >= int(answer.get("total_count") or 0) > 0:
                return
            number += 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.kinds, self.starts = _Folder(options), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on kind and window start choose partitions; all others are left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("kind",):
                self.kinds = values if self.kinds is None else self.kinds & values
            elif values is not None and f.attribute == ("start",):
                self.starts = values if self.starts is None else self.starts & values
            else:
                yield f

    def partitions(self) -> list[Pages]:
        return [Pages(k, w) for k, w in self.folder.windows() if (self.kinds is None or k in self.kinds) and (self.starts is None or w[:8] in self.starts)] or [Pages("", "00000000-00000000")]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.folder.rows(partition) if partition.kind else ()


class _Stream(DataSourceStreamReader):
    """The offset is the number of pages read of each kind and window; a replay reads the same pages."""

    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f"{k}/{w}": self.folder.count(k, w) for k, w in self.folder.windows()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(*name.split("/"), start.get(name, 0) + 1, last) for name, last in sorted(end.items()) if last > start.get(name, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        yield from self.folder.rows(partition)


class PagedFilings(DataSource):
    """(kind, start, end, page, place, and the fields of a filing) of all pages; one partition for each kind and window.

    ``onError`` is ``fail`` or ``skip``: what to do with an answer that tells of an
    error; a window without filings has no rows.  A batch read stops a window
    once it has as many rows as the service says; a stream reads new pages as
    they come.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_filings"

    def schema(self) -> str:
        return "kind string, start string, end string, page int, place int, " + ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
