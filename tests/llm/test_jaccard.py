import random
import re

from pyspark.sql import functions as F

from weftspark.llm.jaccard import components, near_duplicates

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    pairs = {}
    for own in index.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in sets.items()}


def got(df):
    rows = near_duplicates(df).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(g, words, k):
    words = list(words)
    for _ in range(k):
        words[g.randrange(len(words))] = f"e{g.randrange(10**6)}"
    return words


def test_small_cases_equal_brute_force(spark):
    g = random.Random(4)
    rows, bases = [], [[f"b{k}x{i}" for i in range(g.choice((6, 12, 40, 90, 200)))] for k in range(25)]
    shared = [f"s{i}" for i in range(60)]
    for i in range(420):
        base = g.choice(bases)
        w = edited(g, base, g.randrange(0, max(2, len(base) // 25)))
        kind = g.random()
        if kind < 0.15:
            w = [*shared, *(f"r{g.randrange(10**6)}" for _ in range(g.randrange(0, 30)))]
        elif kind < 0.25:
            w = w[: g.randrange(1, 7)]
        elif kind < 0.4:
            w = w[: int(len(w) * g.uniform(0.7, 1))]
        text = g.choice([" ", "\n", " \t"]).join(w)
        rows.append((i * 11 % 421, text.upper() if g.random() < 0.1 else text))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b a b a b a b"), (1004, "A b A b a b a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(df) == brute(rows)


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (2, "a b c d e", 2), (2, "a b c d e", 2), (1, "a b c d e", 3), (5, None, 4)], "doc_id long, text string, n long")
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect())
    assert rows == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (5, 0, 5)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select((F.col("id") * 7 % 61).alias("a"), ((F.col("id") + 1) * 7 % 61).alias("b"))
    assert {r.label for r in components(edges).collect()} == {0}


def test_no_plan_has_many_exchanges(spark, monkeypatch):
    """The driver holds a plan anew with each stage of it, so large ones took its memory."""
    from weftspark.llm import jaccard

    seen = []

    def exchanges(df):
        return sum(line.lstrip(" :+-").startswith("Exchange") for line in df._jdf.queryExecution().executedPlan().treeString().splitlines())

    def spy(df):
        seen.append(exchanges(df))
        return written(df)

    written = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", spy)
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(6)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    seen.append(exchanges(out))
    assert {r.component_id for r in out.collect()} == {0}
    assert max(seen) <= 16, seen
