import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspark.llm.tokens import PieceCounter, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = PieceCounter(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é \n\t▁ﬁ　 <s>/0x0Á")) | st.characters(codec="utf-8"), max_size=60))
def test_cut_counts_equal_the_library(text):
    assert COUNTER.cuts
    assert COUNTER.count(text) == len(MODEL.encode(text))


def test_forgetting_changes_nothing(monkeypatch):
    import weftspark.llm.tokens as m

    monkeypatch.setattr(m, "REMEMBER", 16)
    counter, text = PieceCounter(PATH), " ".join(f"w{i % 40}" for i in range(300))
    assert counter.count(text) == len(MODEL.encode(text))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, PATH).collect()}
    want = {r.doc_id: (len(r.text.encode()), len(MODEL.encode(r.text))) for r in docs.collect()}
    assert got == {k: (b, n, n > 4096) for k, (b, n) in want.items()}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 6), (None, "a b", 6)], "doc_id long, text string, n_tokens int")
    rows = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).collect())
    assert rows == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (2, 3, 2)]
    assert count_tokens(df.limit(0), PATH).count() == 0
