import random

import numpy as np

from lodestone.llm import langid as li

SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "lich", "ung", "ber"], "cc": ["eau", "ou", "ère", "ç"]}


def make(lang, rng, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def brute(model, text):
    """Dense vectors and plain cosines."""
    g = li.grams(text)
    v = np.zeros(li.BUCKETS)
    for b in g:
        v[b] += 1
    v[v > 0] = (1 + np.log(v[v > 0])) * model.idf[v > 0]
    cos = [float(v @ model.centroids[:, j] / np.linalg.norm(v)) for j in range(len(model.langs))]
    return model.langs[int(np.argmax(cos))], max(cos)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, make(lang := rng.choice(list(SYLLABLES)), rng, rng.choice([2, 10, 80])), lang, "x") for i in range(600)]
    rows += [(600, "", "aa", None), (601, None, "bb", None), (602, "123 ##", "aa", None), (603, "kato " * 20_000, None, None), (604, rows[0][1], rows[0][2], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    got = {r.doc_id: r for r in li.learn_and_identify(df).collect()}
    assert len(got) == len(rows)
    out = [i for i, *_ in rows[:600] if got[i].held_out]
    assert 90 < len(out) < 210
    assert np.mean([got[i].lang_pred == rows[i][2] for i in out]) > 0.97
    assert [got[i].lang_pred for i in (600, 601, 602)] == ["und"] * 3 and got[603].lang_pred == "aa"
    assert got[604].score == got[0].score
    assert not any(got[i].rejected for i in range(600))
    assert all(0 <= r.score <= 1 for r in got.values())
    model = li.fit(df.filter("doc_id % 2 = 0"))
    for i in range(0, 600, 7):
        lang, cos = brute(model, rows[i][1])
        pred, score, _ = model.predict(rows[i][1])
        assert pred == lang and abs(score - cos) < 1e-5
    assert model.predict("漢字仮名交じり文は日本語です" * 5)[2]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.learn_and_identify(df).count() == 0
    one = spark.createDataFrame([(0, "abc", None), (None, "abc", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.held_out) for r in li.learn_and_identify(one).collect()} == {("und", False)}


def test_marks_and_copies(spark):
    """Marks alone are no letters; long texts are hashed in pieces alike; copies of one row are in the sample once."""
    rows = [(0, "\u0300\u0301", None), (1, "e\u0301", "aa"), (None, "kato miru", "aa"), *[(5, "schlich ungber", "bb")] * 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df, sample=4)
    got = {r.doc_id: r for r in li.identify(df, model).filter("doc_id is null or doc_id < 9").dropDuplicates(["doc_id"]).collect()}
    assert got[0].lang_pred == "und" and got[0].rejected and got[0].score == 0
    assert got[5].lang_pred == "bb" and got[None].lang_pred == "aa"
    text, piece = make("aa", random.Random(1), 900) + " ß漢", li.PIECE
    whole = np.sort(li.grams(text))
    try:
        for li.PIECE in (1, 7, 1000):
            assert (np.sort(li.grams(text)) == whole).all()
    finally:
        li.PIECE = piece


def test_a_language_left_out_is_rejected(spark):
    """Of the same script as those learned; theirs stay."""
    rng = random.Random(8)
    own = {"k": ["ka", "to", "mi", "ru", "se"], "l": ["lich", "ung", "ber", "ge", "st"], "m": ["tion", "ment", "ou", "que", "le"], "z": ["pri", "voj", "nad", "czy", "bl"]}
    say = lambda lang, n: " ".join("".join(rng.choice(own[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(lang := rng.choice("klm"), rng.choice([6, 20, 80, 300])), lang) for i in range(900)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    other = [model.predict(say("z", n))[2] for n in (6, 20, 80, 300) for _ in range(50)]
    assert np.mean(other) > 0.9
    known = [(lang, model.predict(say(lang, n))) for n in (6, 20, 80, 300) for lang in "klm" for _ in range(50)]
    assert np.mean([p[2] for _, p in known]) < 0.01 and all(p[0] == lang for lang, p in known)
