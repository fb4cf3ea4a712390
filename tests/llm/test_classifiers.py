import random

import numpy as np
from pyspark.sql import functions as F

from weftspark.llm import language, toxicity
from weftspark.llm.queries import op9_toxicity, op10_language

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op10_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = [(i, t, c, 1) for i, (t, c) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("ДОМ и кот", "ru"), (None, "en"), ("x", None)] * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, lang_pred int")
    model = language.fit(df)
    ask = spark.createDataFrame([(1, "the and the"), (1, "the and the"), (2, None), (3, ""), (4, "123 !?"), (None, "und die"), (6, "a")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(ask, model).collect()]
    assert [g[1] for g in got][:6] == ["en", "en", "und", "und", "und", "de"] and got[6][1] in ("en", "de", "fr", "ru")
    assert got[2][2] == 0 and set(model.members) == {"germanic", "romance", "slavic"}
    assert language.fit(df.limit(0)) is None
    assert language.identify(ask, None).filter("lang_pred = 'und'").count() == 7
    assert language.identify(ask.limit(0), model).count() == 0


def test_every_language_is_learned(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    langs = {f"x{i:02}": f"{letters[i % 20]}o{letters[i // 20]}u{letters[i % 20]} " * 6 for i in range(66)}
    docs = [(k, text, c) for k, (c, text) in enumerate(list(langs.items()) * 2)]
    docs += [(1000 + i, langs["x00"], "x00") for i in range(9)]
    model = language.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1))
    assert sorted(model.members) == [f"other {c}" for c in langs]
    ask = spark.createDataFrame([(0, langs["x65"], "x65"), (1, langs["x00"], "x00")], "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in language.identify(ask, model).collect())


def test_toxicity_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op9_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    high, low = p[y == 1][:, None], p[y == 0][None, :]
    auc = ((high > low) + 0.5 * (high == low)).mean()
    assert auc > 0.95 and sum(r.predicted > r.toxic for r in rows) <= 0.002 * len(rows) and sum(r.predicted and r.toxic for r in rows) >= 0.85 * sum(y)


def test_swapping_an_identity_term_changes_no_score(spark):
    g = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [g.choice("one two three four five six seven eight".split()) for _ in range(12)]
        if toxic:
            words[5] = g.choice(["scum", "idiot"])
        if g.random() < (0.8 if toxic else 0.1):
            words[2] = "muslims"  # named far more often in toxic texts
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    ask = ["one two muslims three", "one two jews three", "one two three", "you idiot", "", None]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ask)], "doc_id long, text string, predicted int")
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(df, model).collect()}
    assert abs(got[0][0] - got[1][0]) < 0.05 and got[0][1] == got[2][1] == got[4][1] == got[5][1] == 0 and got[3][1] == 1
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(df, None).agg(F.max("score")).first()[0] == 0


def test_machines_part_what_can_be_parted():
    g = np.random.default_rng(4)
    x = np.concatenate([g.standard_normal((300, 5)) + np.array([2, -1, 0, 0, 1]), g.standard_normal((300, 5)) - np.array([2, -1, 0, 0, 1])]).astype(np.float32)
    x = np.concatenate([x, np.ones((600, 1), np.float32)], axis=1)
    y = np.repeat([1.0, -1.0], 300)
    w, scale = language.svm(x, y)
    assert (np.sign(x @ w) == y).mean() > 0.97 and scale > 0
