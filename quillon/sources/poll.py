"""The paged walk over a feed: a driver-side loop with a request budget, a batch source of its pages, and a stream of its papers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.operators.ratebudget import Limiter
from quillon.sources.feeds import parse_atom
from quillon.sources.lease import SharedLimiter
from quillon.sources.providers import BACKOFF, Transient, attempt

PAGE, MAX_PAGES, INTERVAL_S = 200, 10, 900
#: (category, start, page size) to the page's XML; raises Transient where another try may help.
Fetch = Callable[[str, int, int], str]


@dataclass
class Walk:
    """What a walk over one category did."""

    category: str
    pages: list[dict] = field(default_factory=list)
    fetched: int = 0
    new: int = 0
    oldest: str | None = None
    capped: bool = False  # the page limit was met while rows were still new: there may be a gap
    error: str | None = None

    @property
    def duplicates(self) -> int:
        return self.fetched - self.new


def walk(category: str, fetch: Fetch, seen: set[str], polled_at: str, limiter: Limiter | None = None, page: int = PAGE, max_pages: int = MAX_PAGES, pause: Callable[[int], None] | None = None) -> Iterator[tuple[Walk, list[dict]]]:
    """Yields (the walk so far, new papers) page by page, newest first. Ends at a page without new papers, at the last page, or at
    max_pages. An error after some pages keeps those. A version is marked as seen once the caller asks for the next page, that is after
    it has sent the papers: a crash between can repeat papers but lose none."""
    state = Walk(category)
    for n in range(max_pages):
        if limiter:
            limiter.wait()
        xml, error, _ = attempt(lambda n=n: fetch(category, n * page, page), pause=pause or backoff)
        if error:
            state.error = error
            yield state, []
            return
        total, papers, _ = parse_atom(str(xml), polled_at)
        new = {f"{p['arxiv_id']}v{p['version']}": p for p in papers if f"{p['arxiv_id']}v{p['version']}" not in seen}
        state.fetched += len(papers)
        state.new += len(new)
        state.pages.append({"page": n + 1, "fetched": len(papers), "new": len(new)})
        state.oldest = min([x for x in (state.oldest, *(p["updated_at"] for p in papers)) if x], default=None)
        more = bool(new) and (n + 1) * page < total
        state.capped = more and n + 1 == max_pages
        yield state, list(new.values())
        seen.update(new)
        if not more:
            return


def backoff(n: int) -> None:
    """The pause behind the n-th failed try."""
    time.sleep(BACKOFF[min(n, len(BACKOFF)) - 1])


class _PagePartition(InputPartition):
    def __init__(self, category: str, start: int):
        self.category, self.start = category, start


class FeedSource(DataSource):
    """spark.read.format("paperfeed").option("categories", "a,b").option("pages", 3).option("page_size", 200).option("folder", ...).load():
    raw pages (category, start, xml), one partition a category so that its requests come one after the other.

    Pages are read from files folder/<category>/<start>.xml; a subclass with another `fetch` reads a service."""

    @classmethod
    def name(cls) -> str:
        return "paperfeed"

    def schema(self) -> str:
        return "category string, start int, xml string"

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [_PagePartition(c.strip(), 0) for c in self.options["categories"].split(",") if c.strip()]

    def fetch(self, category: str, start: int) -> str | None:
        import pyarrow.fs as fs

        system, root = fs.FileSystem.from_uri(self.options["folder"])
        info = system.get_file_info(f"{root}/{category}/{start}.xml")
        if not info.is_file:
            return None
        with system.open_input_stream(info.path) as f:
            return f.read().decode()

    def read(self, partition):
        size = int(self.options.get("page_size", PAGE))
        for n in range(int(self.options.get("pages", MAX_PAGES))):
            xml = self.page(partition.category, n * size)
            if xml is None:
                return
            yield partition.category, n * size, xml

    def page(self, category: str, start: int) -> str | None:
        """A page under the budget, busy answers tried again; an error ends the batch, which then runs again."""
        limiter = self.limiter()
        if limiter:
            limiter.wait()
        pauses = [float(x) for x in str(self.options.get("pauses", ",".join(map(str, BACKOFF)))).split(",")]
        xml, error, tries = attempt(lambda: self.fetch(category, start), pause=lambda n: time.sleep(pauses[min(n, len(pauses)) - 1]))
        if error:
            raise RuntimeError(f"{category}, from {start}: {error} ({tries} tries)")
        return xml

    def limiter(self) -> SharedLimiter | None:
        """The budget named by the options `budget` (a folder that all hosts mount) and `interval` (seconds)."""
        if "budget" not in self.options:
            return None
        return SharedLimiter(self.options["budget"], float(self.options.get("interval", 3)))


class _Span(InputPartition):
    """A category's papers that were updated after `after`, up to `upto`."""

    def __init__(self, category: str, after: str, upto: str):
        self.category, self.after, self.upto = category, after, upto


class FeedStreamReader(DataSourceStreamReader):
    """The feed as a stream: a category's offset is the newest time of update that was seen on its first page, so a batch is the papers
    between two times and can be read again. Every request waits for the budget. A batch's papers are the stream's before its end is
    committed: a crash between repeats papers and loses none."""

    def __init__(self, pages: FeedReader):
        self.pages = pages
        self.categories = [p.category for p in pages.partitions()]
        self.seen = dict.fromkeys(self.categories, "")

    def initialOffset(self) -> dict:
        return {c: "" for c in self.categories}

    def latestOffset(self) -> dict:
        for c in self.categories:
            xml = self.pages.page(c, 0)
            if xml is not None:
                self.seen[c] = max([self.seen[c], *(p["updated_at"] for p in parse_atom(xml, "")[1])])
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        for c, upto in end.items():  # a restarted query begins from its checkpoint
            self.seen[c] = max(self.seen.get(c, ""), upto)
        return [_Span(c, start.get(c, ""), upto) for c, upto in end.items() if upto > start.get(c, "")]

    def read(self, span: _Span):
        """(category, key, value): newest first, page by page, as far as the time where the last batch began."""
        size, most = int(self.pages.options.get("page_size", PAGE)), int(self.pages.options.get("pages", MAX_PAGES))
        for n in range(most):
            xml = self.pages.page(span.category, n * size)
            if xml is None:
                return
            total, papers, _ = parse_atom(xml, span.upto)
            for p in papers:
                if span.after < p["updated_at"] <= span.upto:
                    yield span.category, f"{p['arxiv_id']}v{p['version']}", json.dumps(p)
            if not papers or min(p["updated_at"] for p in papers) <= span.after or (n + 1) * size >= total:
                return

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class FeedStream(FeedSource):
    """spark.readStream.format("paperstream") with the options of paperfeed: (category, key, value json) of each paper version."""

    @classmethod
    def name(cls) -> str:
        return "paperstream"

    def schema(self) -> str:
        return "category string, key string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStreamReader(FeedReader(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(FeedStream)


def papers_stream(spark: SparkSession, folder: str, categories: list[str], **options) -> DataFrame:
    """(category, key, value) of a feed's new paper versions, as a stream. options: page_size, pages, budget, interval, pauses."""
    register(spark)
    return spark.readStream.format("paperstream").option("folder", folder).option("categories", ",".join(categories)).options(**options).load()


def pages(spark: SparkSession, folder: str, categories: list[str], n: int = MAX_PAGES, size: int = PAGE) -> DataFrame:
    register(spark)
    return spark.read.format("paperfeed").option("folder", folder).option("categories", ",".join(categories)).option("pages", n).option("page_size", size).load()


__all__ = ["FeedSource", "FeedStream", "Transient", "Walk", "pages", "papers_stream", "register", "walk"]
