"""From raw documents to packed sequences, a stage at a time.

Each stage takes what the one before kept and returns rows with the columns of documents;
the last returns the pieces of packed sequences. Texts are taken whole, however long. Null and
empty texts have no language and go in the first stage; an empty table stays empty; rows that
repeat an id are kept or dropped together until the third stage, which takes the words of the
second away as repeats; extra columns come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm.common import cut, table
from weftspark.llm.decontaminate import without_copies
from weftspark.llm.jaccard import near_duplicates
from weftspark.llm.language import identify, lettered
from weftspark.llm.queries import language_model, packed
from weftspark.llm.substrings import remove_repeats


def apart(docs: DataFrame) -> DataFrame:
    """The columns under numbers for names, so that none is taken for an operator's own."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter: those with none, or no text, have no language and go.

    So it is where no row has a language to learn from, too.
    """
    model = language_model(docs)
    if model is None:
        return lettered(docs)
    told = identify(apart(docs), model, text_column=f"_{docs.columns.index('text')}").filter("lang_pred <> 'und'")
    return told.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near duplicates; those without an id stay."""
    first = near_duplicates(docs).filter("component_id = doc_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; those that are nothing else go, and so do wordless ones."""
    at = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    left = remove_repeats(apart(docs), id_column=at["doc_id"], text_column=at["text"]).filter("n_removed < n_words")
    # A text that has nothing to lose stays as it is, white space included.
    n = F.when(F.col("n_removed") > 0, F.length(at["text"]).cast("long")).otherwise(F.col(at["n_chars"]))
    return left.select(*((n if c == "n_chars" else F.col(own)).alias(c) for c, own in at.items()))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return without_copies(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: No SQL: the language, alignment and tokeniser stages are beyond it. tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is kept as a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
