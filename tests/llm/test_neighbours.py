import numpy as np
from pyspark.sql import functions as F

from weftspark.llm.neighbours import balanced_parts, fit, search


def brute(ids, v, q, k):
    s = (v @ v[q]).tolist()
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
    return [ids[i] for i in order]


def test_parts_are_balanced_and_near_ones_routed():
    g = np.random.default_rng(1)
    x = np.repeat(g.standard_normal((16, 8)), 150, axis=0) + 0.1 * g.standard_normal((2400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:13]
    part = balanced_parts(near, x, 8)
    assert np.bincount(part, minlength=8).max() <= 1.05 * 300 + 1
    router = fit(x)
    assert router.probes <= router.weights.shape[1] // 2


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    out = search(df, F.col("vec_id") % 20 == 0, cell=300)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(v[ids.index(r.query_id)] @ v[ids.index(r.vec_id)])) < 1e-12
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    hits = sum(len(set(got[ids[q]]) & set(brute(ids, v, q, 20))) for q in asked)
    assert hits >= 0.9 * 20 * len(asked) and all(len(x) == 20 for x in got.values())


def test_odd_rows_and_ties(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0])]
    vectors += [(100 + i, [0.5, 0.5]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in search(df, F.col("vec_id") % 20 == 0, cell=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 100, 120}
    assert got[0] == [(100 + i, 0.5) for i in range(20)]
    assert got[120] == [(0, 0.5), (20, 0.5), (20, 0.5), *((100 + i, 0.5) for i in range(17))]
    assert [i for i, _ in got[20]] == [100 + i for i in range(20)]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = search(df.filter("vec_id in (0, 100, 101)"), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == [100, 101]
