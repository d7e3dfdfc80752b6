import random

import numpy as np

from laserloom.llm import reading as R

WORDS = {1: "tap lid saw net box rug key pin", 2: "handle roller bracket sleeve washer socket", 3: "regulator separator generator capacitor resistor", 4: "electropolymerisation thermodemultiplexer chemoconductivity"}
GLUE = "the of and is in to with that a as"


def text(level, r, sentences=25):
    out = []
    for _ in range(sentences):
        out.append(" ".join(r.choice((WORDS[level] if r.random() < 0.5 else GLUE).split()) for _ in range(4 + 5 * level)))
    return ". ".join(out) + "."


def test_levels_are_learned():
    r = random.Random(4)
    train = [(lv, text(lv, r)) for lv in R.LEVELS for _ in range(12)]
    w = np.array([[float(lv == k) for k in R.LEVELS] for lv, _ in train])
    m = R.fit([R.stream_counts(R.sentences(t)) for _, t in train], w)
    score = R.Scorer(m)
    test = [(lv, text(lv, r)) for lv in R.LEVELS for _ in range(5)]
    assert all(score(t) == lv == m.level(R.sentences(t)) for lv, t in test)


def test_what_is_english_prose():
    r = random.Random(5)
    ok = lambda t: R.is_english_prose(t, R.sentences(t) if t else [])
    assert ok(text(2, r)) and not ok(None) and not ok("") and not ok("  \n") and not ok("the box is in the net")
    assert ok(" ".join(["the"] * 60)) and not ok(" ".join(["the"] * 59))
    assert not ok("das Rohr ist mit dem Ventil verbunden und wird gehalten " * 20)
    assert not ok("x = 5.64 m 2 / s\n(II)\nC15H93N2O5\n" * 40) and not ok("<200> ccacggcgtt gcctccgcgt cgtcctgacg\n" * 40)


FOREIGN = {"de": "das rohr ist mit dem ventil verbunden und wird gehalten zwischen gehäuse deckel", "fr": "le tuyau est relié au boîtier tandis que un piston reçoit le palier"}


def babble(words, r, n=80):
    return " ".join(r.choice(words.split()) for _ in range(n)) + "."


def test_the_language_is_learned_from_labels(spark):
    r = random.Random(7)
    docs = [(i, text(i % 4 + 1, r), r.choice(["en", " EN", "en-XX"])) for i in range(60)]
    docs += [(100 + i, babble(FOREIGN[k], r), k) for i, k in enumerate(["de", "fr"] * 10)]
    docs += [(200, text(2, r), "de"), (201, text(3, r), None), (202, babble(FOREIGN["de"], r), "en"), (203, "\\frac{m_6}{y^{2}} C34H35N0O1 (III) " * 40, "en"), (204, "<200> ccacggcgtt gcctccgcgt cgtcctgacg " * 40, None), (205, text(2, r), "und")]
    labels = [(i, i % 4 + 1, "a") for i in range(40)]
    d, lb = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, level int, rater string")
    m = R.train_reading_model(d, lb)
    assert m.language.languages == ["de", "en", "fr"] and np.isfinite(m.language.least)
    got = {x.doc_id: x.level for x in R.unlabelled_levels(d, lb).collect()}
    assert set(got) == {*range(40, 60), 200, 201, 205}
    assert {x.doc_id: x.level for x in R.unlabelled_levels(d, lb, few=3).collect()} == got  # without the broadcast
    # the bound on texts of a language is a parameter
    assert R.train_reading_model(d, lb, per_language=1).language.logp.keys() < m.language.logp.keys()


def test_wrong_labels_make_no_language(spark):
    r = random.Random(8)
    d = spark.createDataFrame([(i, text(i % 4 + 1, r), "fr" if i % 9 == 0 else "en") for i in range(60)], "doc_id long, text string, lang string")
    lb = spark.createDataFrame([(i, i % 4 + 1, "a") for i in range(40)], "doc_id long, level int, rater string")
    assert {x.doc_id for x in R.unlabelled_levels(d, lb).collect()} == set(range(40, 60))


def test_every_text_counts(spark):
    """Models and the bound on prose are made of all rated and all labelled texts, not of some thousands or hundreds."""
    r = random.Random(10)
    own = lambda i: "q" + "".join("abcdefghij"[int(k)] for k in f"{i:04d}")
    docs = [(i, f"{babble(GLUE + ' ' + WORDS[i % 4 + 1], r, r.randint(5, 15))} {own(i)}.", "en") for i in range(2100)]
    docs += [(3000 + i, babble(FOREIGN["de"], r), "de") for i in range(400)] + [(4000 + i, text(2, r), None) for i in range(3)]
    labels = [(i, i % 4 + 1, "a") for i in range(2100)]
    d, lb = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, level int, rater string")
    m = R.train_reading_model(d, lb)
    assert {own(i) for i in range(2100)} <= m.streams["word"].keys() and np.allclose(np.exp(m.prior), 0.25)
    words = lambda lang: [w for _, t, k in docs if k == lang for s in R.sentences(t) for w in s]
    whole = R.LanguageModel.of({k: R.Counter(g for w in words(k) for g in R.trigrams(w)) for k in ("de", "en")})
    assert whole.logp.keys() == m.language.logp.keys() and all(np.allclose(whole.logp[g], v) for g, v in m.language.logp.items())
    score = R.Scorer(m)
    assert np.isclose(m.language.least, np.median([score.read(t)[1] for _, t, k in docs if k == "en"]) - R.PROSE)
    assert {x.doc_id: x.level for x in R.unlabelled_levels(d, lb).collect()} == {4000 + i: 2 for i in range(3)}


def test_counts_passed_on_in_pieces(spark, monkeypatch):
    docs, labels = frames(spark)
    whole = R.train_reading_model(docs, labels)
    monkeypatch.setattr(R, "HELD", 5)
    pieces = R.train_reading_model(docs, labels)
    assert all(whole.streams[k].keys() == v.keys() and all(np.allclose(whole.streams[k][e], x) for e, x in v.items()) for k, v in pieces.streams.items())


def test_a_word_costs_the_same_however_many_are_held():
    import time

    r = random.Random(9)
    train = [(lv, text(lv, r)) for lv in R.LEVELS for _ in range(6)]
    m = R.fit([R.stream_counts(R.sentences(t)) for _, t in train], np.array([[float(lv == k) for k in R.LEVELS] for lv, _ in train]))
    score = R.Scorer(m)

    def cost(n):
        t0 = time.perf_counter()
        for _ in range(n):
            score("the " * 70 + "".join(r.choice("abcdefghij") for _ in range(12)))
        return time.perf_counter() - t0

    cost(300)
    few = cost(300)
    for _ in range(200_000):
        score._row("".join(r.choice("abcdefghij") for _ in range(12)))
    assert cost(300) < 5 * few


def test_broken_words_and_long_texts():
    assert R.sentences("An advanta-\r\ngeous co\xadupling. Two!") == [["an", "advantageous", "coupling"], ["two"]]
    assert sum(map(len, R.sentences("word " * 100_000))) == 100_000


def frames(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(48):
        docs.append((i, text(i % 4 + 1, r)))
        labels.append((i, i % 4 + 1, "r1"))
    labels += [(0, 2, "r2"), (1, 9, "r1"), (None, 1, "r1"), (9999, 1, "r1"), (2, None, "r1")]
    for i in range(100, 120):
        docs.append((i, text(i % 4 + 1, r)))
    docs += [(200, None), (201, ""), (202, "kurz"), (203, "das Rohr ist mit dem Ventil verbunden " * 30)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as level", "1 as __text"), spark.createDataFrame(labels, "doc_id long, level int, rater string")


def test_frames(spark):
    docs, labels = frames(spark)
    got = {r.doc_id: r.level for r in R.unlabelled_levels(docs, labels).collect()}
    assert got == {i: i % 4 + 1 for i in range(100, 120)}
    assert dict(R.unlabelled_levels(docs, labels).dtypes)["level"] == "bigint"
    assert R.unlabelled_levels(docs, labels.limit(0)).count() == 0 == R.unlabelled_levels(docs.limit(0), labels).count()


def test_held_out_accuracy_on_data(spark):
    import os

    import pytest

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/reading_labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    got = {r.doc_id: r.level for r in R.unlabelled_levels(docs.join(labels.select("doc_id").distinct(), "doc_id"), even).collect()}
    want: dict[int, set] = {}
    for r in labels.where("doc_id % 2 = 1").collect():
        want.setdefault(r.doc_id, set()).add(r.level)
    hit = [got.get(i) in v for i, v in want.items()]
    assert len(hit) > 300 and np.mean(hit) > 0.95
