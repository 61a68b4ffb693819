"""Pages and texts go to Python in batches of few bytes, and are parsed once."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verbatlas.functions import html
from verbatlas.plans import catalogue
from verbatlas.sources import pages
from verbatlas.sources.batches import BATCH_BYTES

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(1, "One two three. Four five six.", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "http://a/b", "<p>a block of more than twenty-five characters</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["html_blocks", "html_verse_classes", "html_verse_bare", "html_data_usfm", "scrape_records", "scrape_records_partly", "scrape_failures", "scrape_failures_head"])
def test_batches_of_pages_are_bounded(spark, tables, name):
    own = spark.newSession()
    catalogue.QUERIES[name](own, tables).collect()
    assert own.conf.get(KEY) == BATCH_BYTES


def test_a_batch_is_done_before_the_next_is_taken():
    taken, block = [], "<p>block {} of more than twenty-five characters</p>"

    def batches():
        for k in range(3):
            taken.append(k)
            yield pa.array([block.format(k), None])

    for k, got in enumerate(html._verses.func(batches())):
        assert taken == list(range(k + 1))
        assert got.to_pylist() == [html.verses(block.format(k)), []]


def test_pages_are_parsed_once_for_their_records(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def fetch(k):
        seen.add(1)
        return f"<p>a verse of more than twenty-five characters, {k}</p>"

    raw = spark.range(40).repartition(4).select(F.col("id").alias("ord"), F.lit("u").alias("url"), fetch("id").alias("html"))
    assert pages.records(pages.extract(raw), date="2026-01-01").count() == 40
    assert seen.value == 40


def test_plain_pages_have_the_tree_of_the_full_parser():
    def dump(node):
        return node if isinstance(node, str) else (node.tag, node.attrs, [dump(c) for c in node.children])

    plain = ['<div class="a B">', "<p>", "<P  ID=\"x\" class=\"y\" >", "</p>", "</DIV>", "<br>", "<br/>", '<i data-usfm="1" class="c" class="d" />', "text", "a &amp; b &lt", " &copy ", "\n", "&", "&am", "</b>", "<b>"]
    odd = ["<!-- no -->", "<script>", "</script>", "<a b=c>", "<a b='c'>", '<a b="&amp;">', "<", "< p>", "</ p>", "<a b>", "<!doctype x>", "<?x?>", '<a b="c"d="e">', "<title>", "<a", '<p x="', "<é>", "<p\u00a0a=\"b\">", "</p x>", "<p/ a=\"b\">"]
    rng, quick = random.Random(11), 0
    for k in range(6000):
        page = "".join(rng.choices(plain + odd * (k % 2), k=rng.randint(0, 12)))
        quick += (got := html._parse_plain(page)) is not None
        assert got is None or dump(got) == dump(html._parse_any(page)), page
    assert 3000 <= quick < 6000
    assert html._parse_plain("".join(plain)) is not None and not any(html._parse_plain(x) for x in odd if x != "</script>")
