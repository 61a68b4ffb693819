"""Acquisition: addresses, fetching, extraction and records with dense ids."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verbatlas.functions.html import html_verses
from verbatlas.functions.text import clean_verse
from verbatlas.operators.ranking import global_rank
from verbatlas.sources.batches import bounded_batches
from verbatlas.sources.scratch import materialise

# Book codes with their numbers of chapters, the address of a chapter, and what a request says of its sender.
BOOKS = (
    ("MAT", 28), ("MRK", 16), ("LUK", 24), ("JHN", 21), ("ACT", 28), ("ROM", 16), ("1CO", 16), ("2CO", 13), ("GAL", 6),
    ("EPH", 6), ("PHP", 4), ("COL", 4), ("1TH", 5), ("2TH", 3), ("1TI", 6), ("2TI", 4), ("TIT", 3), ("PHM", 1),
    ("HEB", 13), ("JAS", 5), ("1PE", 5), ("2PE", 3), ("1JN", 5), ("2JN", 1), ("3JN", 1), ("JUD", 1), ("REV", 22),
)
ADDRESS = "https://www.bible.com/bible/1621/%s.%d.GAW"
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept-Language": "en-US,en;q=0.9",
}


def chapter_urls(spark: SparkSession, limit: int | None = None, books=BOOKS, address: str = ADDRESS) -> DataFrame:
    """(ord, book, chapter, url) in order; a limit of 0 or None is none."""
    before = [sum(n for _, n in books[:i]) for i in range(len(books))]
    rows = spark.createDataFrame([(k, b, n) for k, (b, n) in zip(before, books, strict=True)], "before long, book string, n int")
    every = rows.select("before", "book", F.explode(F.sequence(F.lit(1), "n")).alias("chapter"))
    urls = every.select((F.col("before") + F.col("chapter")).alias("ord"), "book", "chapter", F.format_string(address, "book", "chapter").alias("url"))
    return urls.where(F.col("ord") <= limit) if limit else urls


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(0)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options.get("urls", "").split()
        self.delay, self.timeout = float(options.get("delay", 1.5)), float(options.get("timeout", 25))

    def partitions(self) -> list[_Part]:
        return [_Part(self.urls)]  # one polite client: requests are spaced

    def read(self, partition: _Part) -> Iterator[tuple]:
        import urllib.error
        import urllib.request

        for k, url in enumerate(partition.urls):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=HEADERS), timeout=self.timeout) as answer:
                    yield k + 1, url, answer.read().decode("utf-8", "replace"), None
            except (urllib.error.URLError, OSError) as e:
                yield k + 1, url, None, str(e)
            except Exception as e:  # noqa: BLE001  a page never ends the crawl
                yield k + 1, url, None, f"unexpected: {e}"
            time.sleep(self.delay)


class Http(DataSource):
    """``spark.read.format("http_pages")``: ord, url, html, error; options urls (by white space), delay, timeout."""

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "ord long, url string, html string, error string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def extract(pages: DataFrame, ord: str = "ord", least: int = 10) -> DataFrame:
    """Adds ``verses`` (cleaned, over ``least`` characters) and ``reason`` (null for success) to pages(ord, url, html[, error])."""
    error = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    found = F.filter(F.transform(F.col("_raw"), clean_verse), lambda v: F.length(v) > least)
    out = bounded_batches(pages).withColumn("_raw", html_verses(F.col("html"))).withColumn("verses", found).drop("_raw")
    return out.withColumn("reason", F.when(error.isNotNull(), error).when(F.size("verses") == 0, "no verses parsed"))


def records(extracted: DataFrame, ord: str = "ord", date=None) -> DataFrame:
    """(id, url, date_retrieved, raw_text): ids are dense over the successes, in page order.

    Pages are parsed once: their texts are written before the sort, which reads its input twice, and before the filter.
    """
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if date is None else F.lit(date)
    texts = materialise(extracted.select(ord, "url", "reason", F.array_join("verses", " ").alias("raw_text")), "page-texts")
    return global_rank(texts.where("reason IS NULL").drop("reason"), F.asc(ord), name="id").select("id", "url", day.alias("date_retrieved"), "raw_text")


def failures(extracted: DataFrame, first: int | None = None, ord: str = "ord") -> DataFrame:
    """(url, reason) of the pages without a record; of the ``first`` ones by page order only, if given."""
    bad = extracted.where("reason IS NOT NULL")
    return (bad.orderBy(ord).limit(first) if first else bad).select("url", "reason")
