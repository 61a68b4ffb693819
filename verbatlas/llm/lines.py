"""Line dedup by site-relative frequency, in DataFrame operations only.

A page's lines are those between line feeds, compared without the white space
around them. For every (site, line) the pages of the site that hold the line are
counted and divided by the pages of the site, leaving the page itself out: a line
is frequent if it is on more than ``ratio`` of the site's other pages. Pages whose
text is the same count once: copies of one page are no evidence of a template.

A frequent line is boilerplate if the pages that hold it consist mostly of other
text: if frequent lines make up no more than half of their characters. Where they
make up more, the pages are near copies of each other, which is for near-dedup to
judge. Boilerplate goes from every page that shows it, stubs included.

Shuffles carry 64-bit hashes of lines, sites and texts, and the lines that go from
a page are found without its text. The text moves only if more pages lose lines
than ``FEW_ROWS``: below, the (bounded) table of their lines is broadcast. Counting
combines on the map side, so a line that half of a hot site shows is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.llm.common import drop_tables, fresh, materialise

#: Rows (of 16 bytes) and dropped lines (of 8) up to which a table is broadcast; beyond, it is joined by a shuffle.
FEW_ROWS = 100_000
# The white space around a line.
WHITE = " \t\r\x0b\x0c"


def clean_line(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_hash(line: Column) -> Column:
    """0 for a blank line."""
    return F.when(clean_line(line) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(clean_line(line)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_ROWS else df


def boilerplate(pages: DataFrame, ratio: float) -> DataFrame:
    """(site, line) hashes to drop, from ``pages(site, page, size, every(line, chars))``: one row a distinct text."""
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    each = pages.select("site", "page", "size", F.inline("every")).groupBy("site", "page", "line").agg(F.first("size").alias("size"), F.sum("chars").alias("chars"))
    counted = each.groupBy("site", "line").agg(F.count("*").alias("pages"))
    share = (F.col("pages") - 1).cast("double") > F.lit(float(ratio)) * (F.col("total") - 1).cast("double")
    frequent = materialise(counted.where("pages > 1").join(totals, "site").where(share).select("site", "line"), "frequent-lines")
    held = each.join(_small(frequent, frequent.count()), ["site", "line"])
    covered = held.groupBy("site", "page").agg(F.sum("chars").alias("covered"))
    mostly = held.join(covered, ["site", "page"]).groupBy("site", "line").agg(F.sum("covered").alias("covered"), F.sum("size").alias("size"))
    return mostly.where(2 * F.col("covered") <= F.col("size")).select("site", "line")


def drop_boilerplate(docs: DataFrame, site: str = "source", ratio: float = 0.05, hosts: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the boilerplate of its site, plus ``n_lines`` and ``n_dropped``.

    The site of a row is the host that ``hosts(doc_id, host)`` gives for its doc_id,
    else its column ``site``; a null site is a site of its own. A null text stays
    null with 0 lines; an empty text has one empty line; blank lines are never
    boilerplate. Repeated lines of a page count once for the ratio, and all of them
    go. A line that only one of the site's texts holds always stays, so does all of
    a site of one text. Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are
    replaced; other columns, whatever their names, are kept as they are.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")))
    own = F.coalesce(F.concat(F.lit("site:"), F.col(site).cast("string")), F.lit(""))
    row = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id"), own, F.col("text"))
    per_line = F.transform(_lines(F.col("text")), lambda x: F.struct(_line_hash(x).alias("line"), F.length(x).alias("chars")))
    narrow = docs.where(F.col("text").isNotNull()).select(row(1).alias("k1"), row(2).alias("k2"), "doc_id", own.alias("site"), F.xxhash64("text").alias("page"), per_line.alias("every"))
    if hosts is not None:
        known = hosts.where(F.col("doc_id").isNotNull() & F.col("host").isNotNull()).groupBy("doc_id").agg(F.min("host").alias("host"))
        narrow = narrow.join(known, "doc_id", "left").withColumn("site", F.coalesce(F.concat(F.lit("host:"), F.col("host")), F.col("site")))
    distinct = F.array_distinct(F.filter(F.transform("every", lambda x: x["line"]), lambda h: h != 0))
    size = F.aggregate("every", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    pages = materialise(narrow.select("k1", "k2", F.xxhash64("site").alias("site"), "page", size.alias("size"), F.filter("every", lambda x: x["line"] != 0).alias("every"), distinct.alias("lines")), "page-lines")
    once = pages.groupBy("site", "page").agg(F.first("size").alias("size"), F.first("every").alias("every"))
    found = materialise(boilerplate(once, ratio), "boilerplate")
    hit = materialise(
        pages.select("k1", "k2", "site", F.explode("lines").alias("line"))
        .join(_small(found, found.count()), ["site", "line"])
        .groupBy("k1", "k2")
        .agg(F.collect_set("line").alias("gone")),
        "dropped-lines",
    )
    k1, k2, gone = fresh(docs.columns, "k1", "k2", "gone")
    marked = docs.withColumns({k1: row(1), k2: row(2)})
    joined = marked.join(_small(hit.toDF(k1, k2, gone), hit.agg(F.coalesce(F.sum(F.size("gone") + 2), F.lit(0))).first()[0] // 2), [k1, k2], "left")
    drop_tables(docs.sparkSession, pages, found)
    parts = _lines(F.col("text"))
    kept = F.filter(parts, lambda x: ~F.array_contains(F.col(gone), _line_hash(x)))
    lost = F.col(gone).isNotNull()
    return joined.select(
        *(F.when(lost, F.array_join(kept, "\n")).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(lost, F.size(parts) - F.size(kept)).otherwise(0).cast("long").alias("n_dropped"),
    )


#: The same over DuckDB's ``documents`` and ``pages``; formatted with ratio and the pattern of a page's document.
SQL = """
WITH shown AS (
  SELECT doc_id, min(host) AS host FROM (
    SELECT TRY_CAST(regexp_extract(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 2), '{number}', 1) AS BIGINT) AS doc_id,
           {name} AS host
    FROM (SELECT url, lower(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)([^?#]*)', 1)) AS host FROM pages)) WHERE doc_id IS NOT NULL AND host <> '' GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, text, coalesce('host:' || host, 'site:' || source, '') AS site FROM documents d LEFT JOIN shown USING (doc_id)
), lines AS (
  SELECT doc_id, site, text, pos, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS cut
  FROM (SELECT doc_id, site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)
), once AS (
  SELECT site, text, cut, sum(length(line)) AS chars FROM lines WHERE doc_id IN (SELECT min(doc_id) FROM docs GROUP BY site, text) GROUP BY site, text, cut
), sizes AS (
  SELECT site, text, sum(chars) AS size FROM once GROUP BY site, text
), frequent AS (
  SELECT site, cut FROM (SELECT site, cut, count(*) AS pages FROM once WHERE cut <> '' GROUP BY site, cut) JOIN (SELECT site, count(*) AS total FROM sizes GROUP BY site) USING (site)
  WHERE (pages - 1)::DOUBLE > {ratio}::DOUBLE * (total - 1)::DOUBLE
), held AS (
  SELECT o.site, o.text, o.cut, o.chars FROM once o JOIN frequent f ON o.site = f.site AND o.cut = f.cut
), covered AS (
  SELECT site, text, sum(chars) AS covered FROM held GROUP BY site, text
), found AS (
  SELECT h.site, h.cut FROM held h JOIN covered c ON h.site = c.site AND h.text = c.text JOIN sizes z ON h.site = z.site AND h.text = z.text
  GROUP BY h.site, h.cut HAVING 2 * sum(covered) <= sum(size)
), per_doc AS (
  SELECT l.doc_id, count(*) AS n_lines, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.cut IS NULL) AS slim, count(f.cut) AS n_dropped
  FROM lines l LEFT JOIN found f ON l.site = f.site AND l.cut = f.cut GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN n_dropped > 0 THEN coalesce(slim, '') ELSE d.text END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN per_doc j USING (doc_id)
"""
