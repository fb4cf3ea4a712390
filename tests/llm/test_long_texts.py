"""Every operator takes a text of 5 MB whole."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from weftspark.llm import decontaminate, html, jaccard, language, substrings, tokens, toxicity

N = 800_000


@pytest.fixture(scope="module")
def text():
    g = np.random.default_rng(6)
    return " ".join(np.char.add("w", g.integers(0, 10**5, N).astype(str)).tolist())


@pytest.fixture(scope="module")
def docs(spark, text):
    words = text.split(" ")
    words[500_000:500_030] = [f"changed{i}" for i in range(30)]
    rows = [(1, "few words only here"), (2, text), (3, " ".join(words)), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()


def test_copies_of_items(spark, docs, text):
    item = " ".join(text.split(" ")[700_000:700_040])
    found = decontaminate.find_copies(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.first_word, r.end_word, r.score) for r in found) == [(2, 700_000, 700_040, 1.0), (3, 700_000, 700_040, 1.0)]


def test_tokens(docs, text):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()}
    assert got[2] == len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text)) and got[4] == got[5] == 0


def test_near_copies(docs):
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5}


def test_repeats(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digest(docs).collect()}
    assert got == {1: (4, 0), 2: (N, 0), 3: (N, N - 30), 4: (0, 0), 5: (0, 0)}


def test_pages(spark, text):
    page = f"<html><body><nav><a>menu</a></nav><article><p>{text}</p></article><footer>end</footer></body></html>"
    rows = html.extract(spark.createDataFrame([(1, "http://a/b", page)], "page_id long, url string, html string")).collect()
    assert rows[0].text == text and rows[0].n_chars == len(text)


def test_classifiers(spark, docs):
    model = language.fit(spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 4)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got[2] in ("en", "de") and got[4] == got[5] == "und"
    g = random.Random(1)
    rows = [(i, " ".join(g.choice("one two three four".split()) for _ in range(9)) + " idiot" * (i % 2)) for i in range(200)]
    told = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    scored = {r.doc_id: r.score for r in toxicity.score(docs, told).collect()}
    assert len(scored) == 5 and all(0 <= s <= 1 for s in scored.values())
