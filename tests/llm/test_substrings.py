import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from weftspark.llm import substrings
from weftspark.llm.rounds import differences, squeeze, stretch
from weftspark.llm.substrings import WINDOW, anchored, anchors, digest, remove_repeats

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    seen, out = set(), {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        w = SPLIT.findall(text or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - WINDOW + 1):
            t = tuple(w[i : i + WINDOW])
            if t in seen:
                gone[i : i + WINDOW] = True
            seen.add(t)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in digest(df).collect()}


def test_blobs_round_trip():
    g = np.random.default_rng(0)
    a, b = np.sort(g.integers(0, 2**63, 1000).astype(np.uint64)), g.integers(0, 9, 50).astype(np.uint64)
    x, y, z = stretch(squeeze(differences(a), b, b[:0]))
    assert (np.cumsum(x) == a).all() and (y == b).all() and len(z) == 0


def test_equal_windows_have_equal_anchors():
    g = np.random.default_rng(1)
    for alphabet in (2, 5, 1000):
        h = g.integers(0, 2**63, alphabet).astype(np.uint64)
        core = h[g.integers(0, alphabet, 60)]
        texts = [np.concatenate([h[g.integers(0, alphabet, int(g.integers(0, 30)))], core, h[g.integers(0, alphabet, int(g.integers(0, 30)))]]) for _ in range(30)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        name, valid = anchors(np.concatenate(texts), at)
        seen = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                assert valid[at[k] + i] == (i + WINDOW <= len(t))
                if valid[at[k] + i]:
                    assert seen.setdefault(tuple(t[i : i + WINDOW].tolist()), name[at[k] + i]) == name[at[k] + i]


def test_small_cases_equal_brute_force(spark):
    g = random.Random(9)
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((19, 20, 21, 45, 60))]
    rows = []
    for i in range(150):
        words = []
        for _ in range(g.randrange(0, 5)):
            words += g.choice(passages) if g.random() < 0.5 else [g.choice("the of and".split()) for _ in range(g.randrange(60))] if g.random() < 0.5 else [f"u{g.randrange(10**6)}" for _ in range(g.randrange(40))]
        rows.append((i * 7 % 151, g.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1000, "same " * 100), (1001, None), (1002, ""), (1003, "é " * 19), (1004, "é " * 25), (-5, " ".join(passages[4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == brute(rows)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3), (4, None, 4)], "doc_id long, text string, n_words int").coalesce(1)
    rows = sorted((r.doc_id or 0, r.text, r.n_words, r.n_removed) for r in remove_repeats(df).collect() if r.text is not None)
    assert rows == [(0, text, 30, 0), (3, "", 30, 30), (3, "", 30, 30)]
    assert remove_repeats(df.limit(0)).count() == 0


def sent(print_, offset=0):
    """A blob of one window with this print, as a text of its own."""
    one = np.ones(1, np.uint64)
    return squeeze(one * np.uint64(0), one * np.uint64(3), np.array([print_], np.uint64), one * np.uint64(77 * WINDOW + offset), one * np.uint64(0), one * np.uint64(5))


def test_windows_are_compared_by_whole_prints_and_the_anchors_place():
    whole = 0x1234567890ABCDEF
    answers = substrings._reduce([sent(whole), sent(whole), sent(whole ^ 1), sent(whole, 4)])
    assert [a is not None for a in answers] == [False, True, False, False]
    assert [x.tolist() for x in stretch(answers[1])] == [[3], [0]]


def test_prints_are_sent_whole(monkeypatch):
    real = substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda h, k, seed=0: np.arange(len(real(h, k, seed)), dtype=np.uint64) + np.uint64(1 << 63))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(60))])], names=["doc_id", "text"])
    _, names = substrings._scatter(batch, 1, 0, 1)
    _, blobs = substrings._windows(substrings._keep(batch, 0), [names[0]], 1, 0, 1)
    assert sorted(stretch(blobs[0])[2].tolist()) == [(1 << 63) + i for i in range(41)]


def test_a_line_that_100_000_texts_share_is_no_repeat_by_itself():
    g = np.random.default_rng(8)
    line = [f"l{i}" for i in range(10)]
    texts = [" ".join([*(f"w{x}" for x in g.integers(0, 1 << 40, 15)), *line, *(f"w{x}" for x in g.integers(0, 1 << 40, 15))]) for _ in range(100_000)]
    texts[70_000] = texts[20]
    parts = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 10_000)), pa.array(texts[a : a + 10_000])], names=["doc_id", "text"]) for a in range(0, 100_000, 10_000)]
    first = [substrings._scatter(b, 4, 0, 1) for b in parts]
    answers = [[x for r in range(4) if (x := substrings._shared([sent[r] for _, sent in first])[k]) is not None] for k in range(10)]
    second = [substrings._windows(substrings._keep(b, 0), a, 4, 0, 1) for b, a in zip(parts, answers, strict=True)]
    # A third of all windows and more have the line's anchors, but no range gets many more than another.
    sizes = [sum(len(stretch(sent[r])[2]) for _, sent in second) for r in range(4)]
    assert max(sizes) < 1.1 * min(sizes)
    found = [(k, x) for r in range(4) for k, x in enumerate(substrings._reduce([sent[r] for _, sent in second])) if x is not None]
    assert {k for k, _ in found} == {7} and sum(len(stretch(x)[0]) for _, x in found) == 21


def test_equal_windows_have_anchors_at_equal_places():
    g = np.random.default_rng(3)
    for alphabet in (2, 5, 1000):
        h = g.integers(0, 2**63, alphabet).astype(np.uint64)[g.integers(0, alphabet, 3000)]
        h = np.concatenate([h, h[500:900]])
        name, offset, valid = anchored(h, np.array([0, len(h)]))
        seen = {}
        for i in np.flatnonzero(valid):
            assert offset[i] < WINDOW
            assert seen.setdefault(tuple(h[i : i + WINDOW].tolist()), (name[i], offset[i])) == (name[i], offset[i])


def test_a_text_may_have_more_symbols_than_24_bits_count(monkeypatch):
    n = (1 << 24) + 40
    h = np.random.default_rng(5).integers(0, 2**63, n).astype(np.uint64)
    h[-40:] = h[1000:1040]
    place = np.arange(n - WINDOW + 1, dtype=np.int32)
    level = substrings.Symbols(h[place], place * 0, place, place + 1, place, place + WINDOW)
    monkeypatch.setattr(substrings, "parse", lambda h, at: [level, level])
    name, _ = anchors(h, np.array([0, n]))
    assert (name[1000:1021] == name[n - 40 : n - 19]).all()
