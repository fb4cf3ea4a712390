import zlib

from weftspark.llm.sharding import documents_in_shards, shard

M = 2**64


def jump(key, n):
    key, b, j = key % M, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % M
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_matches_the_published_loop_and_moves_only_into_the_new_shard(spark):
    ids = [*range(2000), -1, -(2**63), 2**63 - 1, 987654321987654321]
    rows = documents_in_shards(spark.createDataFrame([(i, f"t{i}é") for i in ids], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {i: (jump(i, 24), jump(i, 25)) for i in ids}
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    for s in range(24):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert all(r.size == len(f"t{r.doc_id}é".encode()) + 8 and r.text_crc32 == zlib.crc32(f"t{r.doc_id}é".encode()) for r in rows)


def test_nulls_repeats_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (7, "", 2), (7, "", 2), (None, "x", 3)], "doc_id long, text string, shard int")
    rows = documents_in_shards(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 8), (0, 9), (7, 8), (7, 8)]
    assert len({(r.shard, r.slot) for r in rows}) == 4
    assert documents_in_shards(df.limit(0)).count() == 0
    assert shard(df, "doc_id", 3).columns == ["doc_id", "text", "shard", "grown_shard", "slot"]


def test_no_column_of_the_input_is_hidden(spark):
    names = ["_n", "_b", "_k", "_r", "____r", "slot"]
    df = spark.createDataFrame([(5, *range(777, 783)), (None, *range(888, 894))], "doc_id long, " + ", ".join(f"{c} int" for c in names))
    out = shard(df, "doc_id", 3)
    assert out.columns == ["doc_id", *names[:-1], "shard", "grown_shard", "slot"]
    assert sorted((r["_n"], r["_b"], r["_k"], r["_r"], r["____r"]) for r in out.collect()) == [tuple(range(777, 782)), tuple(range(888, 893))]


def test_null_keys_are_dealt_to_buckets_and_slots_stay_gapless(spark):
    df = spark.createDataFrame([(None, f"t{i}") for i in range(500)] + [(9, "x" * 5_000_000)], "doc_id long, text string")
    rows = documents_in_shards(df).collect()
    own = sorted(r.slot for r in rows if r.doc_id is None)
    assert sorted(r.slot for r in rows if r.shard == jump(0, 24)) == list(range(500)) if jump(9, 24) != jump(0, 24) else len(set(own)) == 500
    assert [r.size for r in rows if r.doc_id == 9] == [5_000_008]
