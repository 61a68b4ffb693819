import http.server
import json
import threading

import pytest

from verbatlas.functions import html
from verbatlas.sources import crawl, pages, records, scratch, sinks


def test_three_strategies():
    one = '<div class="ChapterContent_verse__x"><span class="ChapterContent_label">1</span><span class="ChapterContent_content__y">Yesu wa ye na</span></div>'
    assert html.verses(one) == ["Yesu wa ye na"]
    assert html.verses('<p class="a ChapterContent_verse__x">bare <b>text</b></p>') == ["bare text"]
    assert html.verses('<i data-usfm="MAT.1.1"> some  <b>words</b></i><p>a long paragraph of more than 25 characters</p>') == ["some words"]
    long = "this block has more than 25 characters"
    page = f"<div><p>{long}</p><span>short</span><p>{long}</p><p>Copyright: {long}</p><script>var x = 'not text but code, and long';</script></div>"
    assert html.verses(page) == [long]  # the div holds a noise marker
    assert html.verses(f"<p>one {long}<p>two {long}</p>") == [f"one {long} two {long}", f"two {long}"]  # unclosed: later siblings are inside
    assert html.verses("<p>a &amp; b <!-- no --> and more text, long enough</p>") == ["a & b and more text, long enough"]
    assert html.verses("") == html.verses(None) == []


def test_records_have_dense_ids_over_successes(spark):
    good = "<p>{} a verse of more than twenty-five characters</p>"
    rows = [(3, "u3", good.format(3), None), (1, "u1", good.format(1), None), (2, "u2", "<p>none</p>", None), (4, "u4", None, "timed out")]
    found = pages.extract(spark.createDataFrame(rows, "ord long, url string, html string, error string"))
    assert {(r.url, r.reason) for r in pages.failures(found).collect()} == {("u2", "no verses parsed"), ("u4", "timed out")}
    got = sorted(pages.records(found, date="2026-01-01").collect())
    assert [(r.id, r.url, r.date_retrieved) for r in got] == [(1, "u1", "2026-01-01"), (2, "u3", "2026-01-01")]
    assert got[1].raw_text == "a verse of more than twenty-five characters"


def test_chapter_addresses(spark):
    got = sorted(pages.chapter_urls(spark).collect())
    assert len(got) == 260 and got[0].url.endswith("MAT.1.GAW") and got[-1].url.endswith("REV.22.GAW")
    assert pages.chapter_urls(spark, 5).count() == 5 and pages.chapter_urls(spark, 0).count() == 260


def test_http_source_reports_failures(spark):
    spark.dataSource.register(pages.Http)
    df = spark.read.format("http_pages").option("urls", "http://127.0.0.1:9/a http://127.0.0.1:9/b").option("delay", 0).option("timeout", 1).load()
    got = df.collect()
    assert [r.ord for r in got] == [1, 2] and all(r.html is None and r.error for r in got)


class _Site(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):  # noqa: N802
        _Site.seen.append((self.path, self.headers.get("User-Agent"), self.headers.get("Accept-Language")))
        good = f'<div class="ChapterContent_verse__x"><span class="ChapterContent_content__y">a verse of {self.path} with ɓ</span></div>'
        body = {"/MAT.2": None, "/MAT.3": "<p>none</p>"}.get(self.path, good)
        self.send_response(404 if body is None else 200)
        self.end_headers()
        self.wfile.write((body or "gone").encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Site.seen.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_crawl_writes_records_and_reports(spark, site, tmp_path):
    out = str(tmp_path / "raw")
    urls = pages.chapter_urls(spark, 5, address=site + "/%s.%d")
    got = crawl.crawl(spark, urls, out, delay=0, date="2026-01-02")
    assert (got.entries, got.fetched, got.parsed, got.skipped) == (3, 5, 3, False)
    assert [u for u, _ in got.failures] == [f"{site}/MAT.2", f"{site}/MAT.3"]
    assert "404" in got.failures[0][1] and got.failures[1][1] == "no verses parsed"
    rows = sorted(records.read_records(spark, out).collect())
    assert [(r.id, r.url) for r in rows] == [(1, f"{site}/MAT.1"), (2, f"{site}/MAT.4"), (3, f"{site}/MAT.5")]
    assert rows[0].raw_text == "a verse of /MAT.1 with ɓ" and rows[0].date_retrieved == "2026-01-02"
    assert len(_Site.seen) == 5 and all(agent.startswith("Mozilla/") and lang.startswith("en") for _, agent, lang in _Site.seen)
    again = crawl.crawl(spark, urls, out, delay=0)
    assert again.skipped and again.entries == 3 and len(_Site.seen) == 5


def test_command_has_an_exit_code(spark, site, tmp_path, capsys):
    run = lambda *a, address: crawl.main([*a, "--delay", "0"], address=address)
    assert run("--limit", "4", "--out", str(tmp_path / "a"), address=site + "/%s.%d") == 0
    assert "4 pages fetched, 2 parsed, 2 records" in capsys.readouterr().out
    assert run("--limit", "4", "--out", str(tmp_path / "a"), address=site + "/%s.%d") == 0
    assert "is there: 2 records" in capsys.readouterr().out
    assert run("--limit", "2", "--out", str(tmp_path / "b"), address="http://127.0.0.1:9/%s.%d") == 1
    assert not (tmp_path / "b").exists() and "MAT.2" in capsys.readouterr().out


def test_failures_can_be_limited(spark):
    rows = [(i, f"u{i}", None, "lost") for i in range(30, 0, -1)]
    found = pages.extract(spark.createDataFrame(rows, "ord long, url string, html string, error string"))
    assert [r.url for r in pages.failures(found, 10).collect()] == [f"u{i}" for i in range(1, 11)] and pages.failures(found).count() == 30


def test_project_root(tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert records.project_root(str(tmp_path / "a" / "b")) == tmp_path.resolve()
    with pytest.raises(FileNotFoundError):
        records.project_root(str(tmp_path), "no such marker")


def test_shared_folder_must_be_named_off_local():
    class Sc:
        master, applicationId = "spark://host:7077", "a"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Sc()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_empty_corpus_is_a_blank_line(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, sent_id int, tokens array<string>")
    sinks.write_corpus(none, str(tmp_path / "c"))
    assert "".join(f.read_text() for f in (tmp_path / "c").glob("part*")) == "\n"
    assert records.read_corpus(spark, str(tmp_path / "c")).count() == 0


def test_json_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "u", "2026-01-01", "ɓei")], records.SCHEMA)
    sinks.write_records(df, path)
    (line,) = [x for f in (tmp_path / "out").glob("part*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert line == '{"id":1,"url":"u","date_retrieved":"2026-01-01","raw_text":"ɓei"}'
    assert records.read_records(spark, path).collect() == df.collect() and records.count_records(spark, path) == 1
    with pytest.raises(ValueError):
        sinks.write_records(df.where("false"), path)
    (tmp_path / "bad.jsonl").write_text(json.dumps({"id": 1}) + "\n\n{oops\n")
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_corpus_text_round_trip_and_line_numbers(spark, tmp_path):
    rows = [(2, 0, ["c", "d"]), (1, 1, ["b"]), (1, 0, ["a", "."])]
    df = spark.createDataFrame(rows, "doc_id long, sent_id int, tokens array<string>")
    sinks.write_corpus(df, str(tmp_path / "c"), one_file=True)
    got = records.read_corpus(spark, str(tmp_path / "c"))
    assert [r.tokens for r in got.orderBy("sent_id").collect()] == [["a", "."], ["b"], ["c", "d"]]
    (tmp_path / "x.txt").write_bytes(b"one\r\ntwo\rthree\n\nfive\x0bsame\n")
    (tmp_path / "y.txt").write_text("other")
    lines = [(r.line_no, r.value) for r in sorted(records.read_lines(spark, str(tmp_path / "x.txt")).collect())]
    assert lines == [(1, "one"), (2, "two"), (3, "three"), (4, ""), (5, "five\x0bsame")]
    assert records.read_first(spark, str(tmp_path / "*.txt")).count() == 5
    assert records.read_whole(spark, str(tmp_path / "y.txt")).first().value == "other"
    assert records.read_whole(spark, str(tmp_path / "x.txt")).first().value == "one\r\ntwo\rthree\n\nfive\x0bsame\n"
    assert [r.value for r in records.preview(records.read_lines(spark, str(tmp_path / "x.txt")), 2, "line_no").collect()] == ["one", "two"]
    line = df.where("doc_id = 2").select(sinks.fixed_width(("doc_id", 4), ("sent_id", "%03d"))).first().line
    assert line == "2    000"
