"""Test items found in training texts: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. A seed is the shortest run of 2 to 4 item
words that the corpus, by its counts of single words and its size, would hold by chance less
than once in ``RARE`` such corpora, so chance makes no more alignments in a larger one. A text
that holds a seed of an item is aligned with it around the seed; edited words cost a little
and unchanged ones gain, so reworded copies are found too.

The items are a bounded index that every task gets; more items than the bound are taken in
blocks, each of which reads the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import batches, gram_hashes, utf8, word_hashes, words

#: Corpora in which a seed stands once by chance; lengths of seeds; bytes of items in a block.
RARE, LENGTHS, BLOCK_BYTES = 1, (2, 3, 4), 8 << 20
#: Alignment: gain of an equal word, cost of another or of a gap; share of the full gain that tells a copy.
EQUAL, OTHER, GAP, SCORE = 2.0, -1.0, -1.0, 0.5
#: Items of fewer words must stand in a text unchanged.
SHORT = 6
#: Bits of the table that rules out most places at once.
SIEVE = 20

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of the texts, and the offsets of each text's words."""
    raw, offsets = utf8(column)
    starts, ends, at = words(raw, offsets, _BETWEEN)
    return word_hashes(raw, starts, ends, lower=True), at


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, and the words of ``text`` it spans (end exclusive)."""
    n = len(text)
    steps = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for w in item:
        down = np.zeros(n + 1)
        came = np.arange(n + 1)
        diagonal = row[:-1] + np.where(text == w, EQUAL, OTHER)
        above = row[1:] + GAP
        down[1:] = np.maximum(np.maximum(diagonal, above), 0)
        came[1:] = np.where(down[1:] <= 0, came[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        # A gap in the item: the best place to the left, less the steps from there.
        lifted = down + steps
        high = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == high, np.arange(n + 1), 0))
        row, begin = high - steps, came[source]
        k = int(np.argmax(row))
        if row[k] > best[0]:
            best = float(row[k]), int(begin[k]), k
    return best


@dataclass
class Items:
    """The index of some test items."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    #: By length: sorted fingerprints of seeds, and for each the items and places that have it.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def plant(self, chance: dict[int, float], total: int) -> None:
        """Choose the seeds, by each word's share of the corpus and the words that it has."""
        least = min([v for v in chance.values() if v > 0], default=1e-9)
        found: dict[int, list[tuple[int, int, int]]] = {n: [] for n in (1, *LENGTHS)}
        enough = -np.log(RARE * max(total, 1))
        for k, w in enumerate(self.words):
            logs = np.log([max(chance.get(int(x), 0.0), least / 2) for x in w]) if len(w) else np.zeros(0)
            grams = {n: gram_hashes(w, n) for n in found}
            placed = []
            for i in range(len(w)):
                for n in LENGTHS:
                    if i + n <= len(w) and logs[i : i + n].sum() <= enough:
                        placed.append((n, i))
                        break
            if len(placed) < 2:  # no rare words: all that it has, at its longest
                n = min(len(w), LENGTHS[-1])
                placed = [(n, i) for i in range(len(w) - n + 1)] if n else []
            for n, i in placed:
                found[n].append((int(grams[n][i]), k, i))
        for n, rows in found.items():
            if rows:
                rows.sort()
                key = np.array([r[0] for r in rows], np.uint64)
                sieve = np.zeros(1 << SIEVE, bool)
                sieve[key >> np.uint64(64 - SIEVE)] = True
                self.seeds[n] = key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), sieve

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, places in the text's words that the item would start at) for texts with seeds."""
        text, item, start = [], [], []
        for n, (key, owner, where, sieve) in self.seeds.items():
            g = gram_hashes(h, n)
            i = np.flatnonzero(sieve[g >> np.uint64(64 - SIEVE)])
            low, high = np.searchsorted(key, g[i], "left"), np.searchsorted(key, g[i], "right")
            i, low, count = i[high > low], low[high > low], (high - low)[high > low]
            t = np.searchsorted(at, i, "right") - 1
            inside = i + n <= at[t + 1]
            i, low, count, t = i[inside], low[inside], count[inside], t[inside]
            which = np.repeat(np.arange(len(i)), count)
            k = low[which] + np.arange(len(which)) - (np.cumsum(count) - count)[which]
            text.append(t[which])
            item.append(owner[k])
            start.append(i[which] - at[t[which]] - where[k])
        if not text:
            return
        text, item, start = (np.concatenate(x) for x in (text, item, start))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        edges = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(edges, [*edges[1:], len(text)], strict=True):
            if b > a:
                yield int(text[a]), int(item[a]), start[a:b]

    def best(self, item: int, text: np.ndarray, starts: np.ndarray) -> tuple[float, int, int]:
        """Best alignment of an item near any of these places: share of the full gain, and words spanned."""
        w = self.words[item]
        slack = len(w) // 2 + 2
        best = (0.0, 0, 0)
        cuts = np.flatnonzero(np.diff(starts) > 2 * slack) + 1
        for group in np.split(starts, cuts):
            a, b = max(0, int(group[0]) - slack), min(len(text), int(group[-1]) + len(w) + slack)
            score, x, y = align(w, text[a:b])
            if score > best[0]:
                best = score, a + x, a + y
        return best[0] / (EQUAL * len(w)), best[1], best[2]

    def copies(self, column: pa.Array, least: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, last word + 1) of the copies in a batch of texts."""
        h, at = word_ids(column)
        out = []
        for t, k, starts in self.hits(h, at):
            score, a, b = self.best(k, h[at[t] : at[t + 1]], starts)
            if score >= (least if len(self.words[k]) >= SHORT else 1.0):
                out.append((t, k, score, a, b))
        return out


def index(docs: DataFrame, items: DataFrame, *, item_column: str = "item_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """Indexes of all items, in blocks of about ``block_bytes``; items without a word are in none."""
    items = items.select(F.col(item_column).alias("id"), F.col(text_column).alias("text")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        out = Items()
        h, at = word_ids(pa.array([r.text for r in rows], pa.string()))
        for i, r in enumerate(rows):
            if at[i + 1] > at[i]:
                out.ids.append(r.id)
                out.words.append(h[at[i] : at[i + 1]].copy())
        if out.ids:
            out.plant(*shares(docs, np.unique(np.concatenate(out.words)), text_column))
            yield out


def shares(docs: DataFrame, vocabulary: np.ndarray, text_column: str = "text") -> tuple[dict[int, float], int]:
    """Of all words of the corpus, the share that each of these is; and how many words it has."""
    sieve = np.zeros(1 << SIEVE, bool)
    sieve[vocabulary >> np.uint64(64 - SIEVE)] = True

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches(source, "text", 4 << 20):
            h, _ = word_ids(b.column(0))
            total += len(h)
            h = h[sieve[h >> np.uint64(64 - SIEVE)]]
            i = np.searchsorted(vocabulary, h)
            i[i == len(vocabulary)] = 0
            n[: len(vocabulary)] += np.bincount(i[vocabulary[i] == h], minlength=len(vocabulary))
        n[-1] = total
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["word", "n"])

    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in rows}
    total = max(1, n.pop(len(vocabulary), 0))
    return {int(vocabulary[k]): v / total for k, v in n.items()}, total


def find_copies(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text", least: float = SCORE) -> DataFrame:
    """A row for each text and item it holds a copy of: ids, score (to 1), first_word, end_word.

    The score is the alignment's gain over that of an unchanged copy. Null and empty texts
    hold nothing and null or wordless items are held nowhere; repeated texts and items are
    answered each; a very long text is read whole; a table without texts or items gives no rows.
    Counting the corpus' words runs at once, the search is lazy. Items are held by the driver and
    every task, a block of BLOCK_BYTES at a time in a task: they are a benchmark, not a corpus.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    item_kind = items.schema[item_column].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, score double, first_word int, end_word int"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = rows.selectExpr("id", f"cast(NULL AS {item_kind}) AS item", "0D AS score", "0 AS first_word", "0 AS end_word").limit(0)
    for block in index(docs, items, item_column=item_column, text_column=text_column):

        def run(source: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in batches(source, "text", 4 << 20):
                found = block.copies(b.column(1), least)
                if found:
                    t, k, score, first, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array([block.ids[i] for i in k]), pa.array(score), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["id", "item", "score", "first_word", "end_word"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_column, "item": item_column})


def without_copies(docs: DataFrame, items: DataFrame, *, item_column: str = "item_id", text_column: str = "text", least: float = SCORE) -> DataFrame:
    """The rows whose texts hold no copy of an item, with all their columns."""
    at = docs.columns.index(text_column)
    out = docs
    for block in index(docs, items, item_column=item_column, text_column=text_column):

        def run(source: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            for b in batches(source, text_column, 4 << 20):
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in block.copies(b.column(at), least)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
