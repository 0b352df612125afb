"""S6 as a Spark data source: pages of issues, each with the link to the next one.

A page is a folder with one JSON file, as a crawler or a Spark job has stored it: status, link (the Link header) and
issues. The driver follows the links, as only a page says which one comes next, and stops at the first page that is
missing, broken or not of status 200; executors read the pages that are wanted, one a partition.

    spark.dataSource.register(IssueSource)
    spark.read.format("issues").option("path", folder).option("limit", 100).load().where("state = 'closed'")

A store of many pages is a table of them instead. followed() follows its links in joins, packed() writes the pages in
their order, many in a file, and with the option "packed" the source reads such a folder, one file a partition.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "pos long, number long, title string, body string, url string, symptom string, state string, label string"


def next_page(link: str | None) -> str | None:
    """The target of the part of a Link header that says rel="next"."""
    for part in (link or "").split(","):
        pieces = part.split(";")
        if len(pieces) == 2 and 'rel="next"' in pieces[1]:
            return pieces[0].strip(" <>\t\n")
    return None


def opened(folder: str):
    """The store's own file system, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def fetch(folder: str, page: str) -> dict:
    """A stored page."""
    from pyarrow import fs

    store, root = opened(folder)
    found = [f for f in store.get_file_info(fs.FileSelector(f"{root}/{page}")) if f.base_name.startswith("part-")]
    with store.open_input_stream(found[0].path) as f:
        return json.loads(f.read())


@dataclass
class Page(InputPartition):
    name: str
    place: int
    take: int | None


class IssueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.first = options["path"], options.get("first", "page=0")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.wanted = {c: options[c] for c in ("state", "label") if c in options}
        self.nothing = False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of state or label is taken over, the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("state",), ("label",)) and self.limit is None:
                own = f.attribute[0]
                self.nothing |= self.wanted.setdefault(own, f.value) != f.value
            else:
                yield f

    def _kept(self, page: dict) -> list[dict]:
        """The page's issues that are no pull requests and of the state and label asked for."""
        own = [x for x in page["issues"] if x.get("pull_request") is None]
        state, label = self.wanted.get("state"), self.wanted.get("label")
        return [x for x in own if (state is None or x.get("state") == state) and (label is None or label in (x.get("labels") or []))]

    def partitions(self) -> list[Page]:
        out, page, n, seen = [], None if self.nothing else self.first, 0, set()
        while page and page not in seen and (self.limit is None or n < self.limit):
            seen.add(page)
            try:
                got = fetch(self.folder, page)
                kept = len(self._kept(got)) if got.get("status") == 200 else None
            except Exception:
                break
            if kept is None:
                break
            out.append(Page(page, len(out), None if self.limit is None else min(kept, self.limit - n)))
            n += kept
            page = next_page(got.get("link"))
        return out or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.name:
            return
        yield from self._rows(fetch(self.folder, partition.name), partition.place, partition.take)

    def _rows(self, page: dict, place: int, take: int | None = None) -> Iterator[tuple]:
        for i, x in enumerate(self._kept(page)[:take]):
            label = self.wanted.get("label") or next(iter(x.get("labels") or []), None)
            yield (place << 32) + i, x.get("number"), x.get("title") or "", x.get("body") or "", x.get("html_url") or "", "", x.get("state"), label


class PackedReader(IssueReader):
    """The same of a folder of packed(): its files are in the order of the links, so no link is followed here."""

    def _pages(self, file: str) -> Iterator[tuple[int, dict]]:
        from pyarrow import parquet

        with opened(self.folder)[0].open_input_file(file) as f:
            for batch in parquet.ParquetFile(f).iter_batches(16, columns=["place", "value"]):
                for place, value in zip(batch["place"], batch["value"]):
                    yield place.as_py(), json.loads(value.as_py())

    def partitions(self) -> list[Page]:
        from pyarrow import fs

        store, root = opened(self.folder)
        files = {} if self.nothing else {int(f.path.split("/block=")[-1].split("/")[0]): f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.base_name.startswith("part-")}
        out, n = [], 0
        for k in sorted(files):
            if self.limit is not None and n >= self.limit:
                break
            out.append(Page(files[k], k, None if self.limit is None else self.limit - n))
            n += 0 if self.limit is None else sum(len(self._kept(page)) for _, page in self._pages(files[k]))
        return out or [Page("", 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if partition.name:
            yield from islice((row for place, page in self._pages(partition.name) for row in self._rows(page, place)), partition.take)


class IssueSource(DataSource):
    """Options: path; first (page=0); limit, issues in all, after pull requests are left out; state, label; packed, if
    the folder is one of packed(). Filters on state and label are pushed down where there is no limit, which comes first."""

    @classmethod
    def name(cls) -> str:
        return "issues"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> IssueReader:
        packed = str(self.options.get("packed", "false")).lower() == "true"
        return (PackedReader if packed else IssueReader)(dict(self.options))


def stored(spark, folder: str) -> DataFrame:
    """page, value of a store that has a folder a page."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").text(folder, wholetext=True)
    return t.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("page"), "value")


def followed(pages: DataFrame, first: str = "page=0") -> DataFrame:
    """page, place of the pages that links lead to from `first`, by pages (page, value), each page once. Jumps over 1, 2,
    4, ... links are joined, so there are as many rounds as the longest way has binary digits. A page that is met again
    keeps its first place."""
    from corvane.sources.store import kept

    def run(batches):
        import pyarrow as pa

        reader = IssueReader({"path": ""})
        for b in batches:
            own, to = [], []
            for page, value in zip(b["page"], b["value"]):
                try:
                    got = json.loads(value.as_py())
                    good = got.get("status") == 200 and reader._kept(got) is not None
                    link = next_page(got.get("link")) if good else None
                except Exception:
                    continue
                if good:
                    own.append(page.as_py())
                    to.append(link)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(to, pa.string())], ["page", "to"])

    links = pages.select("page", "value").mapInArrow(run, "page string, to string")
    t = kept(links.withColumn("place", F.when(F.col("page") == first, F.lit(0).cast("long"))), "links")
    n, step = 0, 1
    while (now := t.where("place IS NOT NULL").count()) > n:
        beyond = t.select(F.col("page").alias("to"), F.col("to").alias("beyond"))
        met = t.where("place IS NOT NULL AND to IS NOT NULL").groupBy(F.col("to").alias("page")).agg((F.min("place") + step).alias("met"))
        jumps = t.join(beyond, "to", "left").select("page", F.col("beyond").alias("to"), "place").join(met, "page", "left")
        t, n, step = kept(jumps.select("page", "to", F.least("place", "met").alias("place")), "links"), now, 2 * step
    return t.where("place IS NOT NULL").select("page", "place")


def packed(pages: DataFrame, path: str, first: str = "page=0", block: int = 250) -> None:
    """Write the pages (page, value) that links lead to from `first` in the order of the links, `block` in a file."""
    own = followed(pages, first).join(pages.select("page", "value"), "page")
    blocks = own.select(F.floor(F.col("place") / block).alias("block"), "place", "value").repartition("block").sortWithinPartitions("block", "place")
    blocks.write.partitionBy("block").parquet(path)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IssueSource)
