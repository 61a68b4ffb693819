import re

import pytest
from pyspark.sql import functions as F

from verbatlas.llm import urls

URLS = [
    "http://Example.NET/en/1", "https://a.example.net/en", "https://a.example.net/en/x?y#z", "https://b.org/fr/1", "http://org/fr/", "http://x.org/frx",
    "http://example.com/de/9", "http://notexample.com/de/9", "http://q.example.com", "ftp://q.example.com?x=/de/", "no scheme", None, "", "a://b://c/d",
    "://", "http://host#frag/en/", "HTTP://ÉÀ.Net/p", "http://u@h.co.uk:80/p q", "x\ny://multi.net/a\nb?c", "http://evilnet/", "http://net",
]


def brute(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "bound") for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, bound string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = urls.judge(pages, none).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or "allow")
    assert urls.judge(pages.where("false"), none).collect() == []


def test_names_and_levels(spark):
    want = {
        "www.a.example.com": ("www.a.example.com", "example.com", "com"), "u:p@blog.gov.uk:8080": ("blog.gov.uk", "blog.gov.uk", "gov.uk"), "x.y.co.jp.": ("x.y.co.jp", "y.co.jp", "co.jp"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1", "10.0.0.1"), "[2001:db8::1]:443": ("[2001:db8::1]", "[2001:db8::1]", "[2001:db8::1]"), "localhost": ("localhost", "localhost", "localhost"),
        "a.b.com.de": ("a.b.com.de", "b.com.de", "com.de"), "co.uk": ("co.uk", "co.uk", "co.uk"), "": ("", "", ""), "shop.de": ("shop.de", "shop.de", "de"), "1.2.3.example": ("1.2.3.example", "3.example", "example"),
    }
    name = urls.name_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in want], "h string").select("h", name.alias("n"), *(c.alias(k) for k, c in zip("ds", urls.levels(name)))).collect()
    assert {r.h: (r.n, r.d, r.s) for r in got} == want


def test_documents_that_pages_show(spark):
    found = {"http://a.b/en/7": 7, "https://a.b/en/7.html": 7, "https://a.b/en/7/?x=3": 7, "https://a.b/7#t": 7, "http://a.b/7/x": None, "http://a.b/": None, "http://a.b/x7": None, "n/7": None, None: None, "http://a.b/9999999999999999999": None}
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    assert {r.page_id: r.doc_id for r in urls.shown(pages).collect()} == {i: n for i, n in enumerate(found.values()) if n is not None}
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert {(r.page_id, r.bad) for r in urls.outcomes(pages, labels).collect()} == {(0, 1), (1, 1), (2, 1), (3, 1)}
    assert urls.outcomes(pages, labels.withColumn("quality", F.lit(None).cast("int"))).count() == 0


def test_the_query_blocks_and_allows_hosts(spark, tmp_path):
    from verbatlas.llm import queries

    pages, labels = [], []
    for h, (host, share) in enumerate((("bad.example.org", 0.8), ("good.example.org", 0.05), ("www.fine.co.uk", 0.1), ("evil.farm.example:81", 0.9), ("x.good.net", 0.0), ("few.example.org", 1.0))):
        for k in range(2 if host.startswith("few") else 60):
            i = 1000 * h + k
            pages.append((len(pages), f"http://{host}/es/{i}.html?page=2"))
            labels.append((i, int(k % 2 == 0 or k >= share * 60), int(k % 2 == 0 and k < share * 60)))
    pages += [(9000, "http://unseen.example.org/es/77"), (9001, None), (9002, "http://bad.example.org/fr/1"), (9003, "http://10.0.0.1/es/5")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op5_host_reputation(spark, str(tmp_path))
    assert dict(got.dtypes) == {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string", "bad_rate": "double", "bound": "double"}
    rows = got.collect()
    by = {}
    for r in rows:
        if r.rule is None:
            by.setdefault(r.host, set()).add(r.verdict)
    assert len(rows) == len(pages)
    assert by == {"bad.example.org": {"block"}, "evil.farm.example:81": {"block"}, "good.example.org": {"allow"}, "www.fine.co.uk": {"allow"}, "few.example.org": by["few.example.org"], "unseen.example.org": by["unseen.example.org"], "": by[""], "10.0.0.1": by["10.0.0.1"]}
    assert {r.verdict for r in rows if r.rule == "net/"} == {"block"} and [r.verdict for r in rows if r.page_id == 9002] == ["allow"]
    rate = {r.host: r.bad_rate for r in rows}
    assert rate["bad.example.org"] > rate["few.example.org"] > rate["good.example.org"]


def test_reputation_shrinks_and_blocks(spark):
    pages, bad, i = [], [], 0
    for host, n, share in (("bad.farm.example", 60, 1.0), ("new.farm.example", 0, 0), ("other.farm.example", 50, 0.9), ("good.site.example", 200, 0.02), ("one.site.example", 1, 1.0), ("w.co.uk", 40, 0.1)):
        for k in range(max(n, 3)):
            pages.append((i, f"http://{host}/x{k}"))
            if k < n:
                bad.append((i, int(k < share * n)))
            i += 1
    how = urls.Reputation(z=1.645)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*bad, (0, None), (99999, 1)], "page_id long, bad int"), how=how)
    by = {r.host: r for r in got.collect()}
    base = (sum(x for _, x in bad) + 0.5) / (len(bad) + 1)
    assert {h for h, r in by.items() if r.verdict == "block"} == {h for h, r in by.items() if r.bound > base} >= {"bad.farm.example", "other.farm.example"}
    assert not {"good.site.example", "w.co.uk"} & {h for h, r in by.items() if r.verdict == "block"}
    assert by["one.site.example"].bad_rate < 0.6 < by["new.farm.example"].bad_rate
    assert by["good.site.example"].bad_rate == pytest.approx(0.02, abs=0.02)
    assert by["bad.farm.example"].bound < by["bad.farm.example"].bad_rate < 1
