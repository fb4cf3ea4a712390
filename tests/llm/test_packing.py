import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftspark.llm.packing import ByteIds, Limits, Piece, pack, pack_documents
from weftspark.llm.queries import packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
IDS = ByteIds(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abS'sl é \n\t\r\x1c 12.,!<|endoftext|>")) | st.characters(codec="utf-8"), max_size=60))
def test_ids_equal_the_library(text):
    assert IDS.fast
    assert list(np.frombuffer(IDS.ids(text), "<u4")) == MODEL.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(IDS.ids("a<|endoftext|>b"), "<u4")[1] == 50256


def test_long_runs_of_white_space_and_very_long_texts():
    for text in ("a" + " " * 5_000_000 + "b", "x" * 1_000_000 + "\n" * 800_000, "word and word " * 400_000):
        assert list(np.frombuffer(IDS.ids(text), "<u4")) == MODEL.encode(text, add_special_tokens=False).ids


def check(rows, texts):
    rows = [r.asDict() for r in rows]
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seq.setdefault(r["sequence_id"], []).append(r)
    for s in seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
        assert sum(r["length"] for r in s) <= 2048 and len(s) <= 256
    for k, own in by.items():
        ids = np.array([*MODEL.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        own.sort(key=lambda r: r["start"])
        at = 0
        for r in own:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert set(by) == set(texts)
    return sum(2048 - sum(r["length"] for r in s) for s in seq.values()), len(seq)


def test_table_round_trip_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padded, n = check(packed(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padded < 2048 and n > 50


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "x " * 9000, 4: " a\n\nb  <|endoftext|>", 5: "a"}
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, start int").coalesce(1)
    padded, _ = check(packed(df).collect(), texts)
    assert padded < 2048
    assert packed(df.limit(0)).count() == 0
    assert packed(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")).count() == 2
    one = pack_documents(df, PATH).filter("doc_id = 4").first()
    assert MODEL.decode(np.frombuffer(one.ids, "<u4")[:-1].tolist(), skip_special_tokens=False) == texts[4]


def test_limits_on_segments_and_loss():
    pieces = [Piece(i, 0, bytes(4 * n), n) for i, n in enumerate([5, 90, 30, 60, 10, 100, 7] * 20)]
    closed, now = pack(pieces, Limits(100, 3, 50), loss=lambda p: p.length // 2)
    every = closed + [now]
    assert all(sum(p.length for p in s) <= 100 and len(s) <= 3 and sum(p.length // 2 for p in s) <= 50 for s in every)
    assert sum(p.length for s in every for p in s) == sum(p.length for p in pieces)
    whole, rest = pack(pieces, Limits(100, 3, 100), cuttable=False)
    assert sorted(p.row for s in whole + [rest] for p in s) == sorted(p.row for p in pieces)
    with pytest.raises(ValueError, match="limit"):
        pack(pieces, Limits(50, 3, 50), cuttable=False)


def test_masks_make_the_limit_on_loss_bind(spark):
    def answers(text, ids):
        """Every third id bears loss in odd documents, each in even ones."""
        return np.arange(len(ids)) % 3 == 0 if text and text[0] == "o" else np.ones(len(ids), bool)

    texts = {i: ("odd" if i % 2 else "even") + " x" * (7 * i % 90) for i in range(120)} | {500: "odd" + " y" * 900, 501: "even" + " y" * 900, 502: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = pack_documents(df, PATH, limits=Limits(100, 9, 40), mask=answers).collect()
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for k, own in by.items():
        own.sort(key=lambda r: r.start)
        ids = np.array([*MODEL.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        assert b"".join(r.ids for r in own) == ids.tobytes()
        assert b"".join(r.mask for r in own) == answers(texts[k], ids).tobytes()
    assert set(by) == set(texts)
    loss = [sum(sum(r.mask[1:]) for r in s) for s in seq.values()]
    tokens = [sum(r.length for r in s) for s in seq.values()]
    assert max(loss) == 40 and max(tokens) <= 100 and max(map(len, seq.values())) <= 9
    assert sum(x == 40 and n < 100 for x, n in zip(loss, tokens, strict=True)) > 20
    assert len(seq) < 1.1 * max(sum(loss) / 40, sum(tokens) / 100)
    with pytest.raises(Exception, match="a mask needs a value for each id"):
        pack_documents(df, PATH, mask=lambda text, ids: np.ones(3, bool)).collect()
