"""Token counts of whole texts, by Arrow batches that return lengths only.

A sentencepiece BPE merges nothing across a space that follows another character, unless
the vocabulary has a piece with a space inside. So texts are cut there, each different cut is
encoded once and its count remembered, and a text's count is the sum. Vocabularies or
normalisers where that doesn't hold are encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weftspark.llm.common import batches

#: The model's mark for a space; and how many remembered cuts a worker keeps at most.
SPACE = "▁"
REMEMBER = 1 << 20
#: Bytes of text in a batch that is worked on at once.
BATCH_BYTES = 8 << 20

_CUT = re.compile(r"(?<=[^ ]) ")


class PieceCounter:
    """Counts the pieces of texts by a sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        plain = self.model.encode("a  b ", out_type=str) == [SPACE + "a", SPACE, SPACE + "b", SPACE]
        ligature = "".join(self.model.encode("ﬁ　x", out_type=str)) == SPACE + "ﬁ　x"
        self.cuts = plain and ligature and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, int] = {}

    def _learn(self, cuts: list[str]) -> None:
        if len(self.known) + len(cuts) > REMEMBER:
            self.known.clear()
        for c, ids in zip(cuts, self.model.encode(cuts, num_threads=1), strict=True):
            # An empty text has no piece, but a lone space that ends a text has one.
            self.known[c] = len(ids) if c else 1

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text, num_threads=1))
        if SPACE in text:
            text = text.replace(SPACE, " ")
        parts = text.split(" ") if "  " not in text and text[0] != " " else _CUT.split(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, parts))
        except KeyError:
            if len(parts) > REMEMBER // 4:  # a text with more cuts than may be remembered
                return sum(self.count_parts(parts[i : i + REMEMBER // 8]) for i in range(0, len(parts), REMEMBER // 8))
            return self.count_parts(parts)

    def count_parts(self, parts: list[str]) -> int:
        new = list({p for p in parts if p not in self.known})
        self._learn(new)
        if any(p not in self.known for p in parts):  # what was known was forgotten meanwhile
            self._learn(list({p for p in parts if p not in self.known}))
        return sum(map(self.known.__getitem__, parts))


def count_tokens(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Texts are never cut short; a text of any
    length is split at safe places only. Repeated rows are counted each; other columns play
    no part; an empty table gives no rows.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(path)
        for batch in batches(source, "text", BATCH_BYTES):
            texts = batch.column(1).to_pylist()
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_column)
