"""A toxicity classifier that is fitted to change no score when an identity term is swapped.

Texts become sets of lower-case words and word beginnings. Features that labelled texts
show to matter go into a logistic regression whose loss has a second part: for labelled
texts that mention an identity term, the squared change of the score when the term is
swapped for another (counterfactual logit pairing). So a neutral mention of a group, alone,
moves no text over the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import batches
from weftspark.llm.language import pick

#: Terms for groups of people; each line holds terms that may stand for one another.
IDENTITY = [line.split() for line in """
muslim christian jewish hindu buddhist catholic protestant atheist sikh
muslims christians jews hindus buddhists catholics protestants atheists sikhs
black white asian latino african european arab native
gay straight lesbian bisexual heterosexual homosexual queer transgender
women men girls boys females males
woman man girl boy female male
immigrant citizen refugee foreigner tourist
immigrants citizens refugees foreigners tourists
mexican american chinese german french spanish indian turkish polish
deaf blind disabled autistic old young elderly
juden christen muslime frauen männer ausländer
juifs chrétiens musulmans femmes hommes étrangers
judíos cristianos musulmanes mujeres hombres extranjeros
""".strip().splitlines()]  # fmt: skip
GROUP_OF = {term: group for group in IDENTITY for term in group}

#: Bounds of the sample by label, features that the model has at most, and lengths of word beginnings.
TOXIC_ROWS, OTHER_ROWS, FEATURES, BEGINNINGS = 3000, 6000, 512, (4, 5, 6)
#: A feature must stand in so many labelled texts; its log odds (nats), alone and times the root of its texts, must be so large.
LEAST_TEXTS, LEAST_ODDS, LEAST_WEIGHT = 5, 1.5, 6.0
#: Weight of the squared change of the score under a swap; L2 penalty.
PAIRING, RIDGE = 1.0, 2e-5

_WORD = re.compile(r"[^\W\d_]+")


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def with_counts(found: Iterable[str], size: int) -> set[str]:
    """Features, and for beginnings of 2 or 3 different words in 300 (or in all) also those with that number after them."""
    counts, least = Counter(found), max(1.0, size / 300)
    return {*counts, *(f"{f}{m}" for f, n in counts.items() if n > 1 for m in (2, 3) if n >= m * least)}


def text_features(words: set[str]) -> set[str]:
    return with_counts((f for w in words for f in features_of(w)), len(words))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, found: set[str]) -> float:
        """Probability for a text that has these features of the model."""
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def swapped(words: set[str]) -> set[str] | None:
    """The words with each identity term replaced by the next of its group, or None without any."""
    terms = words & GROUP_OF.keys()
    if not terms:
        return None
    return (words - terms) | {g[(g.index(t) + 1) % len(g)] for t in terms for g in [GROUP_OF[t]]}


def _largest(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x / n, nearly; it bounds the curvature of the loss."""
    v = np.random.Generator(np.random.PCG64(3)).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(20):
        v = (x @ v) @ x
        v /= np.linalg.norm(v)
    return 1.2 * float(np.square(x @ v).sum()) / max(1, len(x))


def train(features: list[str], texts: list[list[int]], swaps: list[list[int] | None], toxic: np.ndarray) -> ToxicityModel:
    """Weights by accelerated gradient steps, from the features that texts and their swapped forms have."""
    index = {f: i for i, f in enumerate(features)}

    def rows(sets: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sets), len(features)), np.float32)
        for i, found in enumerate(sets):
            out[i, found] = 1
        return out

    x, y = rows(texts), toxic.astype(np.float32)
    pairs = [i for i, s in enumerate(swaps) if s is not None]
    shift = [x[pairs] - rows([swaps[i] for i in pairs])]
    # Every two terms of a group are a swap in a sentence that has nothing else, so none weighs more than another.
    for group in IDENTITY:
        for a, b in zip(group, group[1:] + group[:1], strict=True):
            row = np.zeros((1, len(features)), np.float32)
            row[0, index[a]], row[0, index[b]] = 1, -1
            shift.append(row)
    shift = np.unique(np.concatenate(shift), axis=0)
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w = v = np.zeros(len(features) + 1, np.float32)
    rate = 1 / (0.25 * _largest(x) + RIDGE + 2 * PAIRING * _largest(shift))
    for step in range(500):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = (p - y) @ x / np.float32(len(x)) + np.float32(RIDGE) * np.append(v[:-1], np.float32(0))
        grad[:-1] += np.float32(2 * PAIRING / max(1, len(shift))) * ((shift @ v[:-1]) @ shift)
        new = v - np.float32(rate) * grad
        v, w = new + np.float32(step / (step + 3)) * (new - w), new
    return ToxicityModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, float(w[-1]))


def fit(labelled: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> ToxicityModel | None:
    """A model from texts that join labels 0 or 1; None without both labels.

    At most ``toxic_rows`` and ``other_rows`` labelled ids are fitted on: those whose hashes
    are smallest. Of an id with both labels, the larger holds. Features are the FEATURES
    that speak most for label 1, counted by Spark, and all identity terms.
    """
    one = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).groupBy(id_column).agg(F.max(label_column).alias("_toxic"))
    ids = pick(one, id_column, {1: toxic_rows, 0: other_rows}, "_toxic")
    kind = labelled.schema[id_column].dataType.simpleString()
    known = [tuple(r) for r in one.join(F.broadcast(ids), id_column).select(id_column, "_toxic").collect()]
    if not known:
        return None
    known = labelled.sparkSession.createDataFrame(pa.table({"id": [k for k, _ in known], "toxic": pa.array([t for _, t in known], pa.int32())}), f"id {kind}, toxic int")
    rows = labelled.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(known), "id").select("text", "toxic")

    def spread(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, "text", 1 << 20):
            found = [sorted(text_features(word_set(t))) for t in batch.column(0).to_pylist()]
            toxic = [y for y, f in zip(batch.column(1).to_pylist(), found, strict=True) for _ in f]
            yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.string()), pa.array(toxic, pa.int32())], names=["f", "toxic"])

    n1, n0 = (known.filter(F.col("toxic") == y).count() for y in (1, 0))
    if not n1 or not n0:
        return None
    counted = rows.mapInArrow(spread, "f string, toxic int").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("c1"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("n") - F.col("c1") + 0.5) / (n0 + 1))
    told = counted.filter(F.col("n") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    weight = F.col("odds") * F.sqrt("c1")
    best = [r.f for r in told.filter(weight >= LEAST_WEIGHT).orderBy(F.desc(weight), "f").limit(FEATURES).collect()]
    features = sorted({*best, *GROUP_OF})
    index = {f: i for i, f in enumerate(features)}

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = lambda words: sorted(index[f] for f in text_features(words) & index.keys())
        for batch in batches(source, "text", 1 << 20):
            sets = [word_set(t) for t in batch.column(0).to_pylist()]
            other = [None if s is None else seen(s) for s in map(swapped, sets)]
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([seen(s) for s in sets], kinds), pa.array(other, kinds)], names=["toxic", "found", "swapped"])

    got = sorted((tuple(r) for r in rows.mapInArrow(place, "toxic int, found array<int>, swapped array<int>").collect()), key=repr)
    toxic = np.array([g[0] for g in got])
    return train(features, [g[1] for g in got], [g[2] for g in got], toxic) if got and 0 < toxic.sum() < len(toxic) else None


def score(docs: DataFrame, model: ToxicityModel | None, *, threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """All rows and columns, with ``score`` (0 to 1) and ``predicted`` added or replaced.

    Whole texts are scored, null and empty ones too; without a model every score is 0.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    at = own.index(text_column)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights if model else {}
        counted = {f.rstrip("23") for f in weights}
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches(source, own[at]):
            scores = []
            for text in batch.column(at).to_pylist():
                found: list[str] = []
                words = word_set(text)
                for w in words:
                    f = known.get(w)
                    if f is None:
                        if len(known) > 1 << 20:
                            known.clear()
                        f = known[w] = tuple(x for x in features_of(w) if x in counted)
                    if f:
                        found.extend(f)
                scores.append(model.score(with_counts(found, len(words)) & weights.keys()) if model else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*own, "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema]
    return docs.select(*own).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))
