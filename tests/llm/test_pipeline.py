import zlib

import public_tokenizers
from test_jaccard import brute as components
from test_substrings import SPLIT, WINDOW
from tokenizers import Tokenizer

import corpus_pipeline


def without_repeats(rows):
    seen, out = set(), {}
    for k, text in sorted(rows.items()):
        w = SPLIT.findall(text)
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            t = tuple(w[i : i + WINDOW])
            if t in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(t)
        if not all(gone):
            out[k] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else text
    return out


def test_stages_equal_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    want = kept
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            want = {k: t for k, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_copies":
            found = components(list(before.items()))
            want = {k: t for k, t in before.items() if found[k][1] == k}
        elif name == "repeats":
            want = without_repeats(before)
        else:
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            plain = {k for k, t in before.items() if any(i in t for i in items)}
            assert not plain & set(kept) and len(before) - len(kept) < 2 * len(plain) + 2
            want = {k: before[k] for k in kept}
        assert kept == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {k: len(model.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "length").collect()))[0][0] == min(kept)


def test_without_a_language_to_learn_only_letterless_texts_go(spark):
    texts = {1: "one two", 2: None, 3: "", 4: "12 !?", 5: "été", 6: "дом"}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([(k, t, None, "s", len(t or "")) for k, t in texts.items()], schema)
    # The only row with a language is held out of the training fold.
    held = next(k for k in range(10, 99) if zlib.crc32(str(k).encode()) % 4 == 2)
    one = none.unionByName(spark.createDataFrame([(held, "das Haus", "de", "s", 8)], schema))
    for docs, want in ((none, [1, 5, 6]), (one, [1, 5, 6, held])):
        got = corpus_pipeline.language(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == want


def test_stages_take_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, and columns named as the stages' own."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "a", 9, 5, "x"), (1, long, "en", "a", 9, 5, "x"), (2, long, None, None, None, None, None), (3, None, "en", "a", 0, 5, "x"), (4, "", "de", "b", 0, 1, "y"), (None, "the other text", "en", "a", 3, 2, "z"), (5, "der Hund und die Katze", "de", "b", 5, 3, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id int, n_removed string"
    docs = spark.createDataFrame(rows, schema)
    sf = "/root/testdata/sf0.001"
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.cut(stage(spark, now, sf))
            assert now.columns == docs.columns
        left = sorted((r.doc_id or 0, r.component_id, r.n_removed) for r in now.collect())
        assert left == ([] if empty else [(0, 2, "z"), (1, 5, "x"), (5, 3, "x")])
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert {r.doc_id for r in pieces.collect()} == ({None, 1, 5} if not empty else set())
