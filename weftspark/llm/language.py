"""Hierarchical language identification: the family first, then a vote within it.

A text becomes the unit vector of the square roots of its byte-trigram frequencies (letters
lower-cased, everything else one mark). Linear support vector machines, one for each pair
of families, choose the family; one for each pair of its languages choose the language.
Both levels are fitted on a bounded sample of labelled texts per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.common import batches, utf8

#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Hashed trigrams, those of them that the machines see, and texts looked at together.
BUCKETS, KEPT, TOGETHER = 1 << 14, 3072, 64
#: The bounds of the sample: texts per language; and texts altogether, which many languages share evenly, down to FEWEST each.
PER_LANGUAGE, TEXTS, FEWEST = 800, 51200, 8

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of bucket counts for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    low = _FOLD[raw]
    # The second byte of Latin capitals with accents, so that they match the small letters.
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    x = low.astype(np.uint32)
    if len(x) < 3:
        return out
    code = (((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    for i in range(n):
        a, b = offsets[i], max(offsets[i], offsets[i + 1] - 2)
        if b > a:
            out[i] = np.bincount(code[a:b], minlength=BUCKETS)
    return out


def unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights of a linear hinge-loss machine by dual coordinate descent, and the scale that turns margins into odds.

    The last column of x is 1, for the bias.
    """
    n, d = x.shape
    w, alpha = np.zeros(d, np.float32), np.zeros(n)
    norm = np.einsum("ij,ij->i", x, x)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n):
            new = min(max(alpha[i] - (y[i] * float(x[i] @ w) - 1) / norm[i], 0.0), cost)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margin = (x @ w) * y
    scales = np.geomspace(0.5, 16, 16)
    loss = [np.log1p(np.exp(-s * np.clip(margin, -30, 30))).mean() + 1e-3 * s for s in scales]
    return w, float(scales[int(np.argmin(loss))])


@dataclass
class Votes:
    """Machines for all pairs of some classes."""

    classes: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> Votes:
        out = cls(sorted(set(labels.tolist())))
        fitted = []
        for a, b in combinations(out.classes, 2):
            own = (labels == a) | (labels == b)
            fitted.append(svm(x[own], np.where(labels[own] == a, 1.0, -1.0)))
        if fitted:
            out.weights = np.stack([w for w, _ in fitted], axis=1)
            out.scales = np.array([s for _, s in fitted])
        return out

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most votes, then the surest, and how sure it is (0 to 1)."""
        n, k = len(x), len(self.classes)
        if k == 1:
            return np.zeros(n, int), np.ones(n)
        margins = x @ self.weights
        sure = 1 / (1 + np.exp(-np.clip(margins * self.scales, -30, 30)))
        votes, least = np.zeros((n, k)), np.ones((n, k))
        for m, (a, b) in enumerate(combinations(range(k), 2)):
            for c, p in ((a, sure[:, m]), (b, 1 - sure[:, m])):
                votes[:, c] += p > 0.5
                least[:, c] = np.minimum(least[:, c], p)
        best = np.argmax(votes + least / 2, axis=1)
        return best, least[np.arange(n), best]


@dataclass
class LanguageModel:
    kept: np.ndarray
    families: Votes
    members: dict[str, Votes]

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, np.ndarray]], langs: np.ndarray) -> LanguageModel:
        """From each text's buckets with their counts, and its language."""
        classes = sorted(set(langs.tolist()))
        means = np.zeros((len(classes), BUCKETS))
        for (at, n), lang in zip(texts, langs, strict=True):
            means[classes.index(lang), at] += np.sqrt(n / n.sum())
        means /= np.array([[(langs == c).sum()] for c in classes])
        kept = np.sort(np.argsort(-(means.var(0) + 1e-6 * means.mean(0)), kind="stable")[:KEPT])
        place = np.full(BUCKETS, -1)
        place[kept] = np.arange(len(kept))
        x = np.zeros((len(texts), len(kept) + 1), np.float32)
        for i, (at, n) in enumerate(texts):
            own = place[at] >= 0
            x[i, place[at][own]] = np.sqrt(n[own] / n.sum())
        x[:, -1] = 1
        family = np.array([FAMILY_OF.get(c, f"other {c}") for c in langs])
        return cls(kept, Votes.fit(x, family), {f: Votes.fit(x[family == f], langs[family == f]) for f in sorted(set(family.tolist()))})

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.concatenate([unit(counts)[:, self.kept], np.ones((len(counts), 1), np.float32)], axis=1)
        family, sure = self.families.choose(x)
        langs = np.empty(len(x), object)
        for f, name in enumerate(self.families.classes):
            own = family == f
            if own.any():
                best, p = self.members[name].choose(x[own])
                langs[own] = np.array(self.members[name].classes, object)[best]
                sure[own] *= p
        return langs.tolist(), sure


def pick(rows: DataFrame, key: str, per_class: dict, label: str) -> DataFrame:
    """Ids of at most so many rows of each class: those whose hashes are smallest.

    The classes are counted first, and only hashes so small that some four times as many rows
    have them are looked at, so what meets in a task doesn't grow with the rows.
    """
    count = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] in per_class}
    if not count:
        return rows.select(key).limit(0)
    edge = F.coalesce(*(F.when(F.col(label) == F.lit(c), F.lit(min(2**63 - 1, -(2**63) + 2**64 * (4 * per_class[c] + 100) // n))) for c, n in count.items()))
    hashed = rows.select(key, label, F.xxhash64(key).alias("_hash")).filter(F.col("_hash") <= edge)
    place = F.row_number().over(Window.partitionBy(label).orderBy("_hash", key)).alias("_place")
    first = hashed.select(key, label, place).filter(F.col("_place") <= max(per_class.values())).collect()
    ids = sorted({r[0] for r in first if r["_place"] <= per_class[r[1]]})
    return rows.sparkSession.createDataFrame(pa.table({key: ids}), rows.select(key).schema)


def fit(labelled: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """A model from rows with a language; None without any.

    Every language that occurs is learned, from at most ``per_language`` texts of it, or from
    its share of TEXTS where that is less.
    """
    labelled = labelled.filter(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull())
    langs = sorted(r[0] for r in labelled.select(lang_column).distinct().collect())
    if not langs:
        return None
    ids = pick(labelled, id_column, dict.fromkeys(langs, min(per_language, max(TEXTS // len(langs), FEWEST))), lang_column)
    rows = labelled.join(F.broadcast(ids), id_column).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 1 << 20):
            raw, offsets = utf8(batch.column(0))
            for i, lang in enumerate(batch.column(1).to_pylist()):
                c = trigram_counts(raw[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0]
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype("<u2").tobytes()]), pa.array([c[at].astype("<u4").tobytes()])], names=["lang", "at", "n"])

    got = [r for r in rows.mapInArrow(count, "lang string, at binary, n binary").collect() if r.n]
    got.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    if not got:
        return None
    texts = [(np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<u4").astype(np.float32)) for r in got]
    return LanguageModel.fit(texts, np.array([r.lang for r in got]))


def identify(docs: DataFrame, model: LanguageModel | None, *, text_column: str = "text") -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``score`` added or replaced.

    A text that is null or has no letter, and every text where there is no model, is ``und``
    with score 0. Texts are looked at whole, however long; repeated rows are answered each; an
    empty table stays empty. Where votes tie, the class first by name is taken.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = own.index(text_column)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, own[at]):
            langs, scores = [], []
            texts = batch.column(at)
            for i in range(0, batch.num_rows, TOGETHER):
                some = texts.slice(i, TOGETHER)
                has = [bool(t and _LETTER.search(t)) for t in some.to_pylist()]
                if model is None or not any(has):
                    langs += ["und"] * len(has)
                    scores += [0.0] * len(has)
                    continue
                pred, sure = model.predict(trigram_counts(*utf8(some)))
                langs += [p if h else "und" for p, h in zip(pred, has, strict=True)]
                scores += [float(s) if h else 0.0 for s, h in zip(sure, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema]
    return docs.select(*own).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def lettered(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The rows whose text has a letter, as ``identify`` tells letters."""
    at = docs.columns.index(text_column)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))
