import math
import zlib

import numpy as np

from verbatlas.llm import toxicity


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"{a}{b}" for a in "lamo riten sovu kelba purt".split() for b in "an er il os um ix".split()]
    bad = [f"gronk{s}" for s in "a be ci do elu fam".split()]
    texts, toxic = [], []
    for _ in range(n):
        words = list(rng.choice(vocab, rng.integers(3, 60)))
        hit = rng.random() < 0.15
        if hit:
            words[1:1] = list(rng.choice(bad, 3))
        texts.append(" ".join(words).title())
        toxic.append(int(hit))
    return texts, toxic


def test_risk_finds_held_out_toxic_texts():
    texts, toxic = corpus(1200)
    pos = [t for t, x in zip(texts[:800], toxic[:800]) if x]
    model = toxicity.fit(pos, texts[:800], 0.15)
    got = [model.score(t) >= 0.5 for t in texts[800:]]
    assert np.mean([g == bool(x) for g, x in zip(got, toxic[800:])]) > 0.98
    assert model.score("gronkzzz lamoan") > 20 * model.score("lamoan")  # a form that was never seen
    assert 0 <= model.score("") < 0.5 and model.score(None) == model.score("")


def test_train_score_and_drop(spark):
    texts, toxic = corpus(600, 1)
    texts[5], texts[6], texts[7] = None, "", "lamoan " * 50000
    rows = [(i, t, "x", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic) if i % 2] + [(3, None), (None, 1), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    fold = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0 and i not in (5, 6, 7)]
    assert np.mean([out[i].predicted == toxic[i] for i in fold]) > 0.97
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}


def test_held_out_labels_do_not_matter(spark):
    texts, toxic = corpus(200, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    two = spark.createDataFrame([(i, 1 - x if fold(i) else x) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    assert toxicity.train(docs, one) == toxicity.train(docs, two)


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0]
    assert toxicity.score(docs.where("false"), toxicity.train(docs.where("false"), none)).collect() == []


def plain_risk(pos, rest, w, b, prior):
    """The formula, one document after the other."""
    l = lambda z: math.log1p(math.exp(-z))  # noqa: E731, E741
    g = lambda doc: b + sum(w[k] for k in doc)
    p_up = sum(l(g(d)) for d in pos) / len(pos)
    negative = sum(l(-g(d)) for d in rest) / len(rest) - prior * sum(l(-g(d)) for d in pos) / len(pos)
    return prior * p_up + max(0.0, negative), negative


def test_risk_and_its_gradient_numerically():
    rng = np.random.default_rng(0)
    for shift, sign in ((-1.0, 1), (-6.0, -1)):  # the negative part above zero, and below
        docs = [[sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(n)] for n in (7, 20)]
        docs[0] += [[0, 1, 2]] * 3
        w, b, prior = rng.normal(size=6) + (3.0 if sign < 0 else 0.0) * (np.arange(6) < 3), shift, 0.4
        if sign < 0:
            docs[1] = [[k for k in d if k > 2] for d in docs[1]]
        pos, rest = (toxicity.Rows.of(d) for d in docs)
        value, negative, dw, db = toxicity.risk(pos, rest, w, b, prior)
        want, part = plain_risk(*docs, w, b, prior)
        assert abs(value - want) < 1e-12 and abs(negative - part) < 1e-12 and np.sign(negative) == sign
        at = lambda w, b: plain_risk(*docs, w, b, prior)[0 if sign > 0 else 1] * sign  # noqa: E731, B023
        for k in range(6):
            e = np.eye(6)[k] * 1e-6
            assert abs((at(w + e, b) - at(w - e, b)) / 2e-6 - dw[k]) < 1e-7
        assert abs((at(w, b + 1e-6) - at(w, b - 1e-6)) / 2e-6 - db) < 1e-7


def test_minimising_lowers_the_risk_and_drops_useless_features():
    rng = np.random.default_rng(1)
    toxic = rng.random(800) < 0.2
    docs = [[0] * int(t and rng.random() < 0.9) + [k for k in range(1, 6) if rng.random() < 0.3] for t in toxic]
    pos, rest = toxicity.Rows.of([d for d, t in zip(docs, toxic) if t][:60]), toxicity.Rows.of(docs)
    w, b = toxicity.minimise(pos, rest, 6, 0.2, l1=5e-3)
    assert toxicity.risk(pos, rest, w, b, 0.2)[0] < 0.5 * toxicity.risk(pos, rest, np.zeros(6), math.log(0.25), 0.2)[0]
    assert w[0] > 2 and (np.abs(w[1:]) < 0.2 * w[0]).all()


def test_training_on_executors_equals_fitting_texts(spark):
    texts, toxic = corpus(500, 4)
    texts[9], texts[10] = None, ""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "gronka lamoan"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic) if i % 3] + [(None, 1), (4, 0), (4, None)], "doc_id long, toxic int")
    own = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5]
    mark = {i: toxic[i] for i in own if i % 3} | ({4: toxic[4]} if 4 in own else {})
    positive = [texts[i] for i, x in mark.items() if x]
    want = toxicity.fit(positive, [texts[i] for i in own], sum(mark.values()) / len(mark))
    for parts in (1, 6):
        got = toxicity.train(docs.repartition(parts), labels)
        assert set(got.weights) == set(want.weights) and got.prior == want.prior
        assert all(abs(got.weights[f] - x) < 1e-6 for f, x in want.weights.items()) and abs(got.bias - want.bias) < 1e-6


def test_decision_sums_the_features_of_the_text():
    model = toxicity.Model({"abcdefg": 1.0, "abcd*1": 0.5, "abcd*2": 2.0, "abcde*4": 8.0, "xyz": -3.0}, -0.25, 0.1)
    texts = ["", None, "abcdefg", "ABCDEFG abcdx", "abcdea abcdeb abcdec abcded", "xyz abcdea abcdea", "abcd", "abcde1abcdez"]
    for _ in range(2):  # the second time from the cache
        for t in texts:
            assert model.decision(t) == -0.25 + sum(model.weights.get(f, 0.0) for f in toxicity.document_features(t)), t
    assert toxicity.document_features("Abcde abcdx") == {"abcde", "abcdx", "abcd*1", "abcd*2"}


def test_repeated_rows_and_null_ids(spark):
    model = toxicity.Model({"gronk": 5.0}, -2.0, 0.1)
    docs = spark.createDataFrame([(1, "gronk")] * 2 + [(None, "gronk"), (None, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.predicted) for r in toxicity.score(docs, model).collect()) == [("1", 1), ("1", 1), ("None", 0), ("None", 1)]
    assert [r.text for r in toxicity.drop_toxic(docs, model).collect()] == [None]
