"""Every query on a small folder: columns, types and rows as its contract states them."""

import math

import numpy as np
import pytest

from verbatlas.llm import queries

TYPES = {
    "op1_mixing": {"doc_id": "bigint", "source": "string", "language": "string", "topic": "string", "tokens": "bigint", "weight": "double", "prob": "double", "kept": "boolean", "residual": "double"},
    "op2_additive_ann": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op3_toxicity_nnpu": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_site_lines": {"doc_id": "bigint", "text": "string", "n_lines": "bigint", "n_dropped": "bigint"},
    "op5_host_reputation": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string", "bad_rate": "double", "bound": "double"},
    "op6_packing_gga": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint", "generations": "int", "gained": "int"},
    "op7_language_backoff": {"doc_id": "bigint", "lang_pred": "string", "score": "double", "held_out": "boolean"},
    "op8_simhash_trie": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_lattice_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_license_diagonals": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    path = str(tmp_path_factory.mktemp("contract"))
    words = [f"{a}{b}" for a in "lamo riten sovu kelba".split() for b in "an er il os".split()]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)))) + (" gronka MIT License." if i % 9 == 0 else ""), ("en", "de")[i % 2], f"s{i % 3}", 9) for i in range(90)]
    docs += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, "\u00bd 12 ! 3", "de", "s1", 9), (103, "long " * 3000, "en", "s1", 1), (103, "long " * 3000, "en", "s1", 1), (None, "no id", "en", "s1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 9 == 0)) for i in range(0, 90)] + [(5, None, None), (None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://h{i % 4}.example.{('com', 'net')[i % 2]}/en/{i}.html", "<p>x</p>") for i in range(40)] + [(50, None, None), (51, "no scheme", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(120)] + [(200, None, None), (250, [0.0] * 8, 2), (None, [1.0] * 8, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{empty}/{name}.parquet")
    return path, empty


@pytest.mark.parametrize("name", TYPES)
def test_contract(spark, folder, name):
    path, empty = folder
    found = queries.QUERIES[name](spark, path)
    assert dict(found.dtypes) == TYPES[name]
    rows = found.collect()
    ids = [r[0] for r in rows]
    if name in ("op1_mixing", "op3_toxicity_nnpu", "op4_site_lines", "op7_language_backoff", "op8_simhash_trie", "op10_license_diagonals"):
        assert sorted(map(str, ids)) == sorted(map(str, [*range(90), 100, 101, 102, 103, 103, None]))
    elif name == "op5_host_reputation":
        assert sorted(ids) == [*range(40), 50, 51] and {r.verdict for r in rows} <= {"allow", "block"}
        assert all(r.rule == "net/" and r.verdict == "block" or r.host in ("h1.example.net", "h3.example.net") and r.rule == "example.net/en/" for r in rows if r.host.endswith("net"))
    elif name == "op9_lattice_dedup":
        assert sorted(map(str, ids)) == sorted(map(str, [*range(120), 200, 250, None])) and all(isinstance(r.kept, bool) for r in rows)
    elif name == "op2_additive_ann":
        assert {(r.query_id, r["rank"]) for r in rows} == {(q, k) for q in (0, 50, 100) for k in range(1, 6)} and all(-1 <= r.score <= 1 + 1e-12 for r in rows)
    else:
        assert {str(i) for i in ids} == {str(i) for i in [*range(90), 100, 101, 102, 103, None]} and all(0 < r.length <= 2048 for r in rows)
    if name in ("op3_toxicity_nnpu", "op7_language_backoff"):
        assert all(r.held_out is (str(r.doc_id) != "None" and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and math.isfinite(r.score) for r in rows)
    if name == "op3_toxicity_nnpu":
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    if name == "op7_language_backoff":
        assert {r.lang_pred for r in rows if r.doc_id in (100, 101, 102)} == {"und"} and {r.lang_pred for r in rows} <= {"en", "de", "und"}
    if name == "op10_license_diagonals":
        assert {r.doc_id for r in rows if r.base_labels == "mit"} == set(range(0, 90, 9))
    none = queries.QUERIES[name](spark, empty)
    assert dict(none.dtypes) == TYPES[name] and none.collect() == []
