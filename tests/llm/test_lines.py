from verbatlas.llm import lines

COLUMNS = "doc_id long, text string, source string, n_lines string, _drop int, k1 string, Gone int"
WHITE = " \t\r\x0b\x0c"


def brute(rows, ratio, hosts=None):
    """By row: (text, lines, lines dropped)."""
    hosts = hosts or {}
    site = lambda r: ("host", hosts[r[0]]) if r[0] in hosts else ("site", r[2])
    pages = {}
    for r in rows:
        if r[1] is not None:
            pages.setdefault(site(r), set()).add(r[1])
    cut = lambda t: [x.strip(WHITE) for x in t.split("\n")]
    gone = {}
    for s, texts in pages.items():
        holders = {}
        for t in texts:
            for x in set(cut(t)) - {""}:
                holders.setdefault(x, []).append(t)
        frequent = {x for x, held in holders.items() if len(held) - 1 > ratio * (len(texts) - 1)}
        covered = {t: sum(len(x) for x in t.split("\n") if x.strip(WHITE) in frequent) for t in texts}
        size = {t: sum(map(len, t.split("\n"))) for t in texts}
        gone[s] = {x for x in frequent if 2 * sum(covered[t] for t in holders[x]) <= sum(size[t] for t in holders[x])}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        parts = r[1].split("\n")
        left = [x for x in parts if x.strip(WHITE) not in gone[site(r)]]
        out.append((r[0], "\n".join(left), len(parts), len(parts) - len(left)))
    return sorted(out, key=str)


def sample():
    more = ("x", 1, "user", 3)
    rows = [(i, f"head\nown {i} words of a page that says much\n  foot \nmore {i} of its own", "a", *more) for i in range(12)]
    rows += [(50 + i, f"\thead\r\nlong text {i} of the page\nfoot\x0b\nlong text {i} again", "a", *more) for i in range(6)]
    rows += [(90, "head\nfoot", "a", *more)]  # a stub of nothing but boilerplate
    rows += [(100 + i, f"head\nown {i} words", "b", *more) for i in range(3)] + [(110, "alone\nhead", "b1", *more)]
    rows += [(200 + i, f"a long line that all of these pages share\nanother line that all of them share\nedit {i % 9}", "c", *more) for i in range(40)]  # near copies
    rows += [(300 + i, "same\ntext", "d", *more) for i in range(50)] + [(360 + i, f"other {i}", "d", None, 1, None, None) for i in range(9)]
    rows += [(400, None, "a", *more), (401, "", "a", *more), (402, "\n\n", None, None, None, None, None), (403, "head\nfoot\nhead\n" + "long " * 40000, "a", "", 2, "", 0)]
    rows += [(500 + i, f"nul\nlines {i} and more words", None, *more) for i in range(8)] + [(None, "head\nno id and more words", "a", *more)] * 2
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame(rows, COLUMNS)
    want = brute(rows, 0.2)
    assert sum(n > 0 for *_, n in want) > 25 and ("head" not in {x for i, t, *_ in want if i == 90 for x in t.split("\n")})
    assert all(n == 0 for i, *_, n in want if i is not None and 200 <= i < 240)
    for few in (lines.FEW_ROWS, 0):  # broadcast tables, and shuffled ones
        monkeypatch.setattr(lines, "FEW_ROWS", few)
        got = lines.drop_boilerplate(docs, ratio=0.2)
        assert got.columns == ["doc_id", "text", "source", "_drop", "k1", "Gone", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == want
        assert {(r._drop, r.k1, r.Gone) for r in got.where("doc_id < 300").collect()} == {(1, "user", 3)}


def test_hosts_come_before_sources(spark):
    rows = sample()
    hosts = {i: f"h{i % 2}.example" for i, *_ in rows if i is not None and i % 3 == 0}
    frame = spark.createDataFrame([*hosts.items(), (0, "z.example"), (12345, "x"), (None, "y"), (1, None)], "doc_id long, host string")
    got = lines.drop_boilerplate(spark.createDataFrame(rows, COLUMNS), ratio=0.2, hosts=frame).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=str) == brute(rows, 0.2, hosts)


def test_empty_table_and_repeated_ids(spark):
    assert lines.drop_boilerplate(spark.createDataFrame([], COLUMNS)).collect() == []
    docs = spark.createDataFrame([(1, "a", "s", "", 0, "", 0)] * 3, COLUMNS)
    assert len(lines.drop_boilerplate(docs).collect()) == 3


def test_ratio_of_the_query_in_a_hot_site(spark):
    from verbatlas.llm.queries import LINES

    shares = {"chance": 0.03, "low": 0.06, "mid": 0.08, "high": 0.1}
    rows = []
    for i in range(1000):
        own = [f"own line {i} number {k} of a page" for k in range(6)]
        rows.append((i, "\n".join(own[:3] + [name for k, (name, x) in enumerate(shares.items()) if (i + 250 * k) % 1000 < 1000 * x] + own[3:]), "hot", "x", 1, "", 0))
    rows += [(5000 + i, f"page {i} of another site\nand more {i}", f"site{i % 10}", "x", 1, "", 0) for i in range(100)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, COLUMNS), **LINES).collect()
    left = {name: sum(name in r.text.split("\n") for r in got) for name in shares}
    assert left == {"chance": 30, "low": 0, "mid": 0, "high": 0}
    assert sum(r.n_dropped for r in got) == 240
