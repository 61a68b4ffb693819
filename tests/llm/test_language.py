import math
import unicodedata
import zlib

import numpy as np

from verbatlas.llm import language

STEMS = {"aa": "kalu mite sora venti".split(), "bb": "zwerg blatt kroch schlu".split(), "cc": "ñaro quell esto dón".split()}


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(STEMS)[i % 3]
        words = ["".join(rng.choice(STEMS[lang], rng.integers(1, 4))) for _ in range(rng.integers(2, 40))]
        out.append((lang, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    return out


def test_held_out_accuracy_and_backoff():
    data = corpus(900)
    model = language.fit(data[:600])
    got = [model.predict(t) for _, t in data[600:]]
    assert np.mean([g == lang for (g, _), (lang, _) in zip(got, data[600:])]) > 0.99
    assert all(0 <= s <= 1 for _, s in got)
    assert "zwergzwergzwergblatt" not in model.words and model.predict("zwergzwergzwergblattkroch")[0] == "bb"
    assert not model.backoff("☃").any()
    for n in (5, 4, 3, 2):  # the longest order with a known gram decides
        model.orders[n] = ({}, model.orders[n][1])
        model.forget()
        assert model.predict("ñarox")[0] == "cc"


def test_one_model_term_by_hand():
    model = language.fit([("x", "ab ab b"), ("y", "b b b b")])
    assert np.allclose(model.word_logs[model.words["ab"]], np.log([2.5 / 4, 0.5 / 5]))
    lang, score = model.predict("ab")
    assert lang == "x" and np.isclose(score, (2.5 / 4) / (2.5 / 4 + 0.5 / 5))
    assert model.backoff("ac").tolist() == model.orders[2][1][model.orders[2][0]["^a"]].tolist()


def plain(data, text, orders=(5, 4, 3, 2, 1)):
    """(language, score) straight from the training texts, one word at a time, without any table."""
    words = lambda t: "".join(c if unicodedata.category(c).startswith("L") else " " for c in (t or "").lower()).split()
    langs = sorted({lang for lang, t in data if words(t)})
    seen = {lang: [w for other, t in data if other == lang for w in words(t)] for lang in langs}
    cut = lambda w, n: list(w) if n == 1 else [("^" + w + "$")[i : i + n] for i in range(len(w) + 3 - n)]

    def logs(x, units):
        kinds = len({u for every in units.values() for u in every})
        return [math.log((units[lang].count(x) + 0.5) / (len(units[lang]) + 0.5 * kinds)) for lang in langs]

    grams = {n: {lang: [g for w in seen[lang] for g in cut(w, n)] for lang in langs} for n in orders}
    total, count = [0.0] * len(langs), 0
    for w in words(text):
        count += 1
        if any(w in every for every in seen.values()):
            own = logs(w, seen)
        else:
            own = [0.0] * len(langs)
            for n in orders:
                known = [g for g in cut(w, n) if any(g in every for every in grams[n].values())]
                if known:
                    own = [sum(x) / len(known) for x in zip(*(logs(g, grams[n]) for g in known))]
                    break
        total = [a + b for a, b in zip(total, own)]
    if not count or not langs:
        return "und", 0.0
    mean = [x / count for x in total]
    best = max(range(len(langs)), key=lambda k: mean[k])
    return langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)


def test_predictions_equal_a_plain_version():
    data = corpus(30, 3)
    model = language.fit(data)
    texts = [t for _, t in corpus(45, 4)] + ["kalu kalu zwerg", "☃", "x½²ⅧⅨy kalux", "½²Ⅷ", "quello storto nuovo", "ΟΔΟΣ ñaro", "", None, "a_b1c"]
    for t in texts:
        lang, score = model.predict(t)
        want, close = plain(data, t)
        assert lang == want and abs(score - close) < 1e-9, t


def test_only_letters_make_words():
    assert language.letters("½² Ⅷ ٣ 12 _ ª日本 x²y ǅ ʰ e\u0301a") == ["ª日本", "x", "y", "ǆ", "ʰ", "e", "a"]
    model = language.fit([("aa", "kalu"), ("bb", "zwerg")])
    assert model.predict("½² Ⅷ 1_") == ("und", 0.0) and model.predict("日")[0] in ("aa", "bb")
    assert "kalu" in model.words  # seen once, and known


def test_ties_go_to_the_first_language_and_rows_repeat(spark):
    model = language.fit([("bb", "same"), ("aa", "same")])
    assert model.predict("same same") == ("aa", 0.5)
    docs = spark.createDataFrame([(1, "same", "x")] * 3 + [(None, "same", None)], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in language.predict(docs, model).collect()) == [("1", "aa", 0.5)] * 3 + [("None", "aa", 0.5)]


def test_rows_and_folds(spark):
    data = corpus(300, 1)
    rows = [(i, t, lang, 0.1) for i, (lang, t) in enumerate(data)] + [(900, None, "aa", 0.0), (901, "", None, 0.0), (902, "12 !? 3", "bb", 0.0), (903, "kalu " * 60000, None, 0.0), (903, "kalu", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.train(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    assert len(got) == len(rows)
    by = {i: (lang, s) for i, lang, s in got}
    assert by[900] == by[901] == by[902] == ("und", 0.0) and by[903][0] == "aa"
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert np.mean([by[i][0] == data[i][0] for i in range(300) if fold(i)]) > 0.98
    other = spark.createDataFrame([(i, t, "zz" if fold(i) else lang, s) for i, t, lang, s in rows], docs.schema)
    assert language.train(other).languages == model.languages
    none = docs.where("false")
    assert language.predict(none, language.train(none)).collect() == []
    assert {r.lang_pred for r in language.predict(docs, language.train(none)).collect()} == {"und"}
