"""Acquisition from end to end: fetch addresses, write records, report; also a command.

    python -m verbatlas.sources.crawl --limit 3 --delay 1.5 --out data/raw
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from verbatlas.sources import pages, records, sinks
from verbatlas.sources.scratch import drop_tables, materialise

SHOWN = 10


@dataclass
class Report:
    """``fetched`` and ``parsed``: pages seen and pages with verses; ``failures``: the first of them; ``skipped``: the output was there."""

    entries: int
    fetched: int = 0
    parsed: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)
    skipped: bool = False


def crawl(spark: SparkSession, urls: DataFrame, out: str, delay: float = 1.5, timeout: float = 25, date: str | None = None) -> Report:
    """Fetch ``urls(ord, url)`` in order and write their records to ``out``.

    If ``out`` exists nothing is fetched and its records are counted. Pages are
    fetched once and kept in the shared folder while records and failures are made
    of them. Without a single record nothing is written.
    """
    if records.exists(spark, out):
        return Report(records.count_records(spark, out), skipped=True)
    spark.dataSource.register(pages.Http)
    addresses = " ".join(r["url"] for r in urls.orderBy("ord").select("url").toLocalIterator())
    reader = spark.read.format("http_pages").option("urls", addresses).option("delay", delay).option("timeout", timeout)
    seen = Observation("crawl")
    got = pages.extract(reader.load()).observe(seen, F.count("*").alias("fetched"), F.count_if(F.col("reason").isNull()).alias("parsed"))
    kept = materialise(got, "crawl")
    progress = seen.get
    failed = [(r["url"], r["reason"]) for r in pages.failures(kept, SHOWN).collect()]
    if progress["parsed"]:
        sinks.write_records(pages.records(kept, date=date), out)
    drop_tables(spark, kept)
    return Report(progress["parsed"], progress["fetched"], progress["parsed"], failed)


def main(argv: list[str] | None = None, address: str = pages.ADDRESS) -> int:
    """0 if there are records, else 1."""
    parser = argparse.ArgumentParser(description="Fetch chapters into JSON Lines")
    parser.add_argument("--limit", type=int, default=None, help="only the first chapters")
    parser.add_argument("--delay", type=float, default=1.5, help="seconds between requests")
    parser.add_argument("--out", default="data/raw", help="folder of the records")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("crawl").getOrCreate()
    report = crawl(spark, pages.chapter_urls(spark, args.limit, address=address), args.out, args.delay)
    if report.skipped:
        print(f"{args.out} is there: {report.entries} records")
    else:
        print(f"{report.fetched} pages fetched, {report.parsed} parsed, {report.entries} records in {args.out}")
    for url, reason in report.failures:
        print(f"{url}: {reason}")
    return 0 if report.entries else 1


if __name__ == "__main__":
    sys.exit(main())
