import hashlib

import numpy as np
import pytest

from verbatlas.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, prob double, _kept string"
TARGETS = mixing.Targets(
    language=(("en", 0.6), ("de", 0.4), ("xx", 0.1)), topic=(("prose", 0.7), ("table", 0.3)), source_power=0.5, budget=0.4, rounds=60
)


def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        text = " ".join(["w"] * int(rng.integers(1, 90)))
        if i % 5 == 0:
            text = f"a | b | {text}"
        out.append((i, text, "en" if rng.random() < 0.8 else "de", source, 0.5, "x"))
    return out


def test_weights_meet_every_target_and_probabilities_the_budget(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, COLUMNS), TARGETS).toPandas()
    assert len(got) == len(data) and list(got.columns[:5]) == ["doc_id", "text", "lang", "source", "prob"]
    cell = got.drop_duplicates(["_source", "_language", "_topic"])
    share = lambda c: (cell.groupby(c)._weight.sum() / cell._weight.sum()).to_dict()
    assert share("_language") == pytest.approx({"en": 0.6, "de": 0.4})
    assert share("_topic") == pytest.approx({"prose": 0.7, "table": 0.3})
    own = got.groupby("_source")._tokens.sum() ** 0.5
    assert share("_source") == pytest.approx((own / own.sum()).to_dict(), rel=1e-6)
    assert (got._tokens * got._prob).sum() == pytest.approx(0.4 * got._tokens.sum())
    assert got._prob.between(0, 1).all()
    u = got.doc_id.map(lambda i: int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:13], 16) / 2**52)
    assert (got._kept == (u < got._prob)).all()
    assert (got._tokens * got._kept).sum() == pytest.approx(0.4 * got._tokens.sum(), rel=0.15)


def test_odd_rows(spark):
    data = [(1, None, "en", "a", 0.0, ""), (2, "", None, None, 0.0, ""), (2, "x y", "qq", None, 0.0, ""), (None, "word " * 60000, "en", "a", 0.0, "")]
    got = mixing.mix(spark.createDataFrame(data, COLUMNS), TARGETS).collect()
    assert len(got) == 4
    by = {(r.doc_id, r._tokens): r for r in got}
    assert by[1, 0]._prob == 0.4 and by[2, 0]._weight == 0
    assert by[2, 2]._prob == 0  # a language without a share
    assert by[None, 60000]._weight > 0
    assert mixing.mix(spark.createDataFrame([], COLUMNS), TARGETS).collect() == []


def test_residual_tells_whether_targets_are_met(spark):
    rows = [(i, "some words here" + (" | a | b |" if i % 3 == 0 else ""), "en" if i % 2 else "de", f"s{i % 5}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _kept int")
    met = mixing.Targets(language=(("en", 0.6), ("de", 0.4)), topic=(("prose", 0.7), ("table", 0.3)), rounds=12)
    got = mixing.mix(docs, met).collect()
    assert len({r._residual for r in got}) == 1 and got[0]._residual < 1e-6
    sums = {}
    for r in got:
        for k in (r._language, r._topic):
            sums.setdefault(k, {})[r._source, r._language, r._topic] = r._weight
    total = sum(w for k in ("en", "de") for w in sums[k].values())
    assert all(abs(sum(sums[k].values()) / total - share) < 1e-6 for k, share in (("en", 0.6), ("de", 0.4), ("prose", 0.7), ("table", 0.3)))
    rows = [(i, "some words here" + (" | a | b |" if i % 2 else ""), "en" if i % 2 else "de", "s", 0) for i in range(400)]  # tables are all English
    open_ = mixing.mix(spark.createDataFrame(rows, docs.schema), met).collect()
    assert open_[0]._residual > 0.1
    assert mixing.mix(docs.where("false")).collect() == []
