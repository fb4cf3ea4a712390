"""The thin queries over the training-data operators, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.decontaminate import find_copies

    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftspark.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.substrings import digest

    return digest(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm.sharding import documents_in_shards

    return documents_in_shards(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Packing of documents as the contract has it; the ids are given by their CRC-32."""
    import public_tokenizers

    from weftspark.llm.packing import Limits, pack_documents

    out = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), limits=Limits(2048, 256, 2048))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm import toxicity
    from weftspark.llm.language import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 3), F.lit(0)) == 1).alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame):
    from weftspark.llm import language

    return language.fit(docs.filter(language.fold(F.col("doc_id"), 4) != 2))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftspark.llm import language

    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (F.coalesce(language.fold(F.col("doc_id"), 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_jaccard": op4_jaccard,
    "op5_html": op5_html,
    "op6_substrings": op6_substrings,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * o.c >= 80 * (x.n + y.n - o.c)),
r(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(label) AS c FROM r GROUP BY id) m ON m.id = d.doc_id""",
    "op6_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM x) WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT t.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY t.p) AS s FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p WHERE c.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op7_sharding": r"""
WITH RECURSIVE z(k, i, c) AS (SELECT k, 0, k FROM generate_series(0, 255) x(k) UNION ALL SELECT k, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE i < 8),
t AS (SELECT list(c ORDER BY k) AS t FROM z WHERE i = 8),
h AS (SELECT doc_id, string_split(hex(encode(coalesce(text, ''))), '') AS h, t FROM documents, t),
b AS (SELECT doc_id, len(h) // 2 AS n, t, list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda p: (instr('0123456789ABCDEF', h[2 * p + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * p + 2]) - 1)) AS l FROM h),
d AS (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, xor(list_reduce(l, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b),
j(doc_id, n, k, b, j) AS (SELECT doc_id, n, doc_id::UHUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (24), (25)) v(n)
  UNION ALL SELECT doc_id, n, q, j, CAST(floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((q // 8589934592)::DOUBLE + 1))) AS BIGINT) FROM (SELECT doc_id, n, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS q FROM j WHERE j < n)),
s AS (SELECT doc_id, max(CASE WHEN n = 24 THEN b END) AS shard, max(CASE WHEN n = 25 THEN b END) AS grown FROM j WHERE j >= n GROUP BY doc_id),
p AS (SELECT d.*, shard, grown, (xor(d.doc_id, 25214903917)::UHUGEINT * 2862933555777941757 + 1) % 18446744073709551616 // 18014398509481984 AS bucket FROM d JOIN s ON d.doc_id = s.doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard FROM p""",
}
