"""Paged listings as a Spark data source: one partition a page, with pacing and retries inside the partition.

A listing is an index (a JSON object with `recent`, parallel arrays of the newest filings, and `pages`, the older pages with the last day that each reaches) and the
older pages (parallel arrays each). The reader looks at the index alone to decide which pages are needed: older ones only if the recent list doesn't reach
back to the first wanted day, and of these only the ones that reach into the window. Every needed page becomes an input partition, so pages are fetched side by side,
a lost executor costs its own pages again, and no page passes through the driver.

    register(spark)
    spark.read.format("filings").option("path", folder).option("start", "2024-01-01").load()

Options: path (where `index` and the pages lie), start (first wanted ISO day; all pages without it), fetch (`file`: a folder that all executors
see, or `http`), agent (names the user to a server), delay and wait (seconds before a request, and before the first retry; doubled for each
further one), retries, on_failure (`raise`, or `list`: a row with failed = true in place of the page).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.types import StructType

from .files import Fetcher, InputError

#: Columns of a listing and the arrays of a page that hold them.
FIELDS = {"accession": "accessionNumber", "filed": "filingDate", "form": "form", "items": "items", "document": "primaryDocument"}
SCHEMA = "page string, position int, accession string, filed string, form string, items string, document string, failed boolean"


def file_text(path: str, name: str) -> str | None:
    """The text of a page in a folder: a file, or the one file of a folder of that name. None if there is none or it can't be read."""
    system, root = fs.FileSystem.from_uri(path)
    try:
        at = system.get_file_info(f"{root}/{name}")
        if at.type == fs.FileType.Directory:
            inside = [i for i in system.get_file_info(fs.FileSelector(at.path)) if i.is_file and not i.base_name.startswith(("_", "."))]
            if len(inside) != 1:
                return None
            at = inside[0]
        with system.open_input_stream(at.path) as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


class Page(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class PagesReader(DataSourceReader):
    """Which pages are needed is known before any is read; `start` may also come from a filter on `filed`."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise InputError("the source needs the option path")
        self.path, self.start = options["path"].rstrip("/"), options.get("start", "")
        self.delay, self.wait = float(options.get("delay", "0")), float(options.get("wait", "0.25"))
        self.retries, self.on_failure = int(options.get("retries", "3")), options.get("on_failure", "raise")
        if self.on_failure not in ("raise", "list"):
            raise InputError(f"on_failure is raise or list, not {self.on_failure}")
        kind = options.get("fetch", "file")
        if kind not in ("file", "http"):
            raise InputError(f"fetch is file or http, not {kind}")
        self.http = Fetcher(options.get("agent", "meridian"), delay=self.delay) if kind == "http" else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """A lower bound of the day saves pages; all filters stay with Spark, for a page holds other days as well."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo) and f.attribute == ("filed",) and isinstance(f.value, str):
                self.start = max(self.start, f.value)
            yield f

    def ask(self, name: str) -> str | None:
        """One request for a page."""
        if self.http:
            return self.http.get(f"{self.path}/{name}")  # waits by itself
        time.sleep(self.delay)
        return file_text(self.path, name)

    def text(self, name: str) -> str | None:
        """A page's text, asked for up to `retries` times more."""
        for k in range(self.retries + 1):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            if (got := self.ask(name)) is not None:
                return got
        return None

    def partitions(self) -> list[Page]:
        text = self.text("index")
        if text is None:
            raise InputError(f"no index at {self.path}")
        index = json.loads(text)
        oldest = min(index.get("recent", {}).get(FIELDS["filed"], []), default=None)
        older = index.get("pages", []) if not self.start or oldest is None or oldest >= self.start else []
        return [Page("index"), *(Page(p["name"]) for p in older if p.get("filingTo", "") >= self.start)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        text = self.text(partition.name)
        if text is None:
            if self.on_failure == "raise":
                raise OSError(f"page {partition.name} of {self.path} could not be read")
            yield _batch(partition.name, [[None]] * len(FIELDS), True)
            return
        block = json.loads(text)
        if partition.name == "index":
            block = block.get("recent", {})
        lists = [block.get(a) or [] for a in FIELDS.values()]
        n = min(map(len, lists))  # as many rows as the shortest array has
        if n:
            yield _batch(partition.name, [x[:n] for x in lists], False)


def _batch(page: str, lists: list[list], failed: bool) -> pa.RecordBatch:
    n = len(lists[0])
    columns = [pa.array([page] * n), pa.array(range(n), pa.int32()), *(pa.array([None if v is None else str(v) for v in x], pa.string()) for x in lists), pa.array([failed] * n)]
    return pa.RecordBatch.from_arrays(columns, ["page", "position", *FIELDS, "failed"])


class Filings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))


def register(spark: SparkSession, source: type[DataSource] = Filings) -> None:
    """Make the source known to the session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def write_listing(recent: DataFrame, older: DataFrame, path: str) -> None:
    """A listing in a folder: `recent` (columns of FIELDS) goes into the index, `older` (page, and these columns) into a file a page, written by the tasks that hold them.

    The recent list and each page must be small enough to be one cell; the index also holds the name and the last day of each page."""
    order = ["filed", *(c for c in FIELDS if c != "filed")]
    lists = F.sort_array(F.collect_list(F.struct(*order))).alias("x")
    block = F.to_json(F.struct(*(F.col(f"x.{c}").alias(a) for c, a in FIELDS.items()))).alias("json")
    older.groupBy("page").agg(lists).select("page", block).write.partitionBy("page").text(path)
    pages = older.groupBy("page").agg(F.max("filed").alias("filingTo")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("page="), "page").alias("name"), "filingTo")))).alias("pages"))
    index = recent.agg(lists).select(block).join(pages, F.lit(True)).select(F.concat(F.lit('{"recent":'), "json", F.lit(',"pages":'), "pages", F.lit("}")).alias("json"))
    index.coalesce(1).write.text(f"{path}/index")
