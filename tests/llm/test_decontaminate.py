import random

import numpy as np

from weftspark.llm.decontaminate import align, find_copies, without_copies

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("sto", "vin", "del", "gar") for c in ("", "n", "x", "us")]


def plain(item, text):
    """Smith-Waterman, cell by cell."""
    h = [[0.0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item):
        for j, b in enumerate(text):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a == b else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_one():
    g = random.Random(5)
    for _ in range(200):
        a = [g.randrange(6) for _ in range(g.randrange(1, 9))]
        b = [g.randrange(6) for _ in range(g.randrange(0, 15))]
        score, first, end = align(np.array(a), np.array(b, int))
        assert score == plain(a, b) == plain(a, b[first:end])


def test_exact_edited_and_absent(spark):
    g = random.Random(3)
    passage = lambda n: [g.choice(WORDS) + g.choice(WORDS) for _ in range(n)]
    items = [passage(30) for _ in range(6)]
    docs, want = [], {}
    for i in range(120):
        body = passage(150)
        if i % 4 == 0:
            k = (i // 4) % 6
            copy = list(items[k])
            if i % 8 == 0:
                for at in range(3, 30, 6):
                    copy[at] = "edited"
                del copy[10]
                copy.insert(20, "and more")
            body[40:40] = [copy[0].upper() + ",", *copy[1:]]
            want[i] = k
        elif i % 4 == 1:
            body[40:40] = items[i % 6][:8]  # a few words in common aren't a copy
        docs.append((i, " ".join(body), i))
    docs += [(500, None, 0), (501, "", 0), (502, " ".join(items[0]), 0), (502, " ".join(items[0]), 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (90, None), (91, ""), (92, "no such")], "item_id long, text string")
    got = find_copies(df, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([*want.items(), (502, 0), (502, 0)])
    assert all(r.first_word == 40 and r.score == 1 for r in got if r.doc_id % 8 == 4 and r.doc_id < 500)
    assert sorted(r.doc_id for r in without_copies(df, bench).collect()) == sorted({d[0] for d in docs} - {502} - set(want))
    assert find_copies(df.limit(0), bench).count() == 0 and find_copies(df, bench.limit(0)).count() == 0
    assert without_copies(df, bench.limit(0)).count() == len(docs)


def test_table_finds_every_unchanged_item(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in find_copies(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    plainly = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    assert plainly and plainly <= got and len(got) < 2 * len(plainly)


def test_copies_equal_brute_force(spark):
    """All items against all texts, aligned cell by cell."""
    g = random.Random(11)
    passage = lambda n: [g.choice(WORDS) + g.choice(WORDS) for _ in range(n)]
    items = [passage(g.randrange(8, 16)) for _ in range(5)]
    docs = []
    for _ in range(60):
        body = passage(g.randrange(0, 40))
        for _ in range(g.randrange(0, 3)):
            copy = list(g.choice(items))
            for _ in range(g.randrange(0, 4)):
                at = g.randrange(len(copy))
                copy[at : at + g.randrange(0, 2)] = passage(g.randrange(0, 2))
            at = g.randrange(len(body) + 1)
            body[at:at] = copy[: g.choice((3, len(copy), len(copy)))]
        docs.append(body)
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in find_copies(df, bench).collect()}
    share = {(d, k): plain(w, body) / (2 * len(w)) for d, body in enumerate(docs) for k, w in enumerate(items)}
    want = {x: s for x, s in share.items() if s >= 0.5}
    assert len(want) > 20 and set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)
