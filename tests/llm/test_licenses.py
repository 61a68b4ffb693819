import re

from verbatlas.llm import licenses

FULL = licenses.TEMPLATES[2][1]
TEXTS = {
    1: None, 2: "", 3: "...", 4: "Released under the MIT License.", 5: "x MIT\nLICENSE mit-license apache  License",
    6: "the general public license; GENERAL PUBLIC LICENSE", 7: "general public", 8: "license mit", 9: "émit license mité license",
    10: "Licensed under CC BY-NC 4.0.", 11: "a " * 30000 + "Licensed under the Apache License, Version 2.0",
    12: "intro " + FULL.replace("software", "nice software", 1).replace("merge, ", "") + " outro",
    13: " ".join(FULL.split()[:20]), 14: " ".join(reversed(FULL.split())), 15: "MIT License " * 500, 16: "permission is hereby granted İ K license",
}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_and_method_labels(spark):
    docs = spark.createDataFrame([(k, t, "l", 0) for k, t in TEXTS.items()] + [(4, TEXTS[4], None, None)], "doc_id long, text string, labels string, score int")
    got = licenses.scan(docs).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r.doc_id: r for r in got}
    for k, t in TEXTS.items():
        assert (by[k].n_words, by[k].n_base, by[k].first_word, by[k].last_word, by[k].base_labels) == brute(t), k
        assert set(filter(None, by[k].base_labels.split(","))) <= set(by[k].labels.split(","))
    assert by[4].labels == "mit" and by[4].score == 1.0
    assert by[10].labels == "cc-by-nc" and by[10].base_labels == ""
    assert by[11].labels == "apache" and by[11].score == 1.0
    assert by[12].labels == "mit" and 0.75 <= by[12].score < 1
    assert by[13].labels == by[14].labels == "" and by[13].score == by[2].score == 0
    assert licenses.scan(docs.where("false")).collect() == []


def test_span_places(spark):
    docs = spark.createDataFrame([(11, TEXTS[11])], "doc_id long, text string")
    (s,) = licenses.spans(licenses.features(docs)).collect()
    assert (s.first_word, s.last_word, s.label) == (30000, 30007, "apache")
