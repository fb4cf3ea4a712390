"""Approximate nearest neighbours with learned partitions.

On a bounded sample: a graph of nearest neighbours is cut into parts of equal size so that
few neighbours are parted; a small softmax classifier learns in which parts a vector's
neighbours lie. Every row is put into its most probable part. A query goes to its most
probable parts - as many as the sample needs for the wanted recall - and is ranked there
against all rows, exactly.

Parts lie in cells of bounded size: several small parts share one, and a part with many rows
(one vector may be a third of all) is dealt to several. A query is sent to a cell once, with
the parts it probes there, so what is sent depends on the number of cells and not of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.llm.common import cut, partitions

#: Bounds: sampled vectors, rows per cell at most, sampled vectors per part, parts. More parts
#: leave fewer rows to rank at equal recall, but a part can't be learned from fewer vectors.
SAMPLE, CELL, PER_PART, PARTS = 6000, 1 << 16, 20, 256
#: Neighbours in the graph; recall that the sample must reach.
DEGREE, RECALL = 12, 0.93


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 12) -> np.ndarray:
    """A part for each node of a neighbour graph (a row of neighbours per node).

    Halving along principal directions gives equal parts; then nodes move to the part that
    most of their neighbours are in while it has room, or change places with a node there.
    """
    n = len(x)
    part = np.zeros(n, int)
    for level in range(parts.bit_length() - 1):
        new = part * 2
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                y = x[own] - x[own].mean(0)
                v = np.random.Generator(np.random.PCG64(p)).standard_normal(x.shape[1])
                for _ in range(12):
                    v = y.T @ (y @ v)
                    v /= np.linalg.norm(v) + 1e-12
                new[own[np.argsort(y @ v, kind="stable")[len(own) // 2 :]]] += 1
        part = new
    room = int(np.ceil(n / parts * slack)) + 1
    sizes = np.bincount(part, minlength=parts)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    near = [np.array([*graph[i], *back[i]], int) for i in range(n)]
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(rounds):
        moved = 0
        for i in order.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]] and sizes[best] < room:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """Scores of parts for vectors: softmax(normalised vector @ weights + bias)."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ self.weights + self.bias

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(self.logits(x), axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def fit(x: np.ndarray, k: int = 20, recall: float = RECALL, rounds: int = 150) -> Router:
    """A router from sampled vectors (in double precision)."""
    n, d = x.shape
    parts = 1
    while parts < PARTS and n >= 2 * parts * PER_PART:
        parts *= 2
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), 1)
    most = min(n - 1, max(DEGREE, k))
    near = np.empty((n, most), int)
    for i in range(0, n, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        near[i : i + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    part = balanced_parts(near[:, :DEGREE], x, parts)
    target = np.zeros((n, parts))
    for c in range(DEGREE):
        np.add.at(target, (np.arange(n), part[near[:, c]]), 1.0)
    np.add.at(target, (np.arange(n), part), 2.0)
    target /= target.sum(1, keepdims=True)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    router = Router(np.zeros((d, parts)), np.zeros(parts), parts)
    w = np.zeros((d + 1, parts))
    unit = np.concatenate([unit, np.full((n, 1), 0.3)], axis=1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = unit @ w
        p = np.exp(z - z.max(1, keepdims=True))
        g = unit.T @ (p / p.sum(1, keepdims=True) - target) / n + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    router.weights, router.bias = w[:-1], 0.3 * w[-1]
    # As many probes as the sample's own neighbours, put into parts as all rows will be, call for.
    home, order = router.home(x), np.argsort(-router.logits(x), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    found = np.array([np.take_along_axis(rank, home[near[:, c : c + 1]], 1)[:, 0] for c in range(most)])
    share = np.cumsum(np.bincount(found.ravel(), minlength=parts)) / found.size
    router.probes = int(np.searchsorted(share, recall) + 1)
    return router


def _valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def cells_of(sizes: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """The first cell of each part, and over how many it is spread; neighbouring small parts share one."""
    first, count = np.zeros(len(sizes), int), np.ones(len(sizes), int)
    at, room = -1, 0
    for p, n in enumerate(sizes.tolist()):
        if n > cell:
            first[p], count[p] = at + 1, -(-n // cell)
            at, room = at + count[p], 0
        elif n:
            if n > room:
                at, room = at + 1, cell
            first[p] = at
            room -= n
    return first, count


def search(vectors: DataFrame, queries: Column, *, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, cell: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, id, score of the ``k`` rows of largest inner product for each row that ``queries`` holds for.

    A query's own id is no candidate. Vectors that are null, zero, of another length than
    most, or that hold null or non-finite components take no part; nor do rows without an
    id. Of repeated query ids one is asked; repeated candidates are ranked each; ties go to
    the smaller id. Texts play no part. An empty table gives no rows. Fits, and puts rows
    into parts, at once; the search itself is lazy. ``cell`` bounds the rows of a cell; left
    out, there are some cells for each of the session's partitions, of CELL rows at most.
    """
    rows = vectors.filter(F.col(id_column).isNotNull() & _valid(F.col(vector_column)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda v: v.cast("double")).alias("v"), queries.alias("asked"))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return rows.selectExpr("id AS query_id", "1 AS rank", f"id AS {id_column}", "0D AS score")
    d = lengths[0].d
    rows = rows.filter(F.size("v") == d)
    some = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    router = fit(np.array([r.v for r in some], float), k, recall)

    def flat(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), float).reshape(-1, d)

    def homes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(router.home(flat(b.column(1))).astype(np.int32))], names=["id", "v", "part"])

    parts = router.weights.shape[1]
    placed = cut(rows.select("id", "v").mapInArrow(homes, "id long, v array<double>, part int"))
    sizes = np.zeros(parts, int)
    for r in placed.groupBy("part").count().collect():
        sizes[r.part] = r["count"]
    if cell is None:
        cell = int(min(CELL, max(1024, -(-sizes.sum() // (2 * partitions(vectors.sparkSession))))))
    first, count = cells_of(sizes, cell)
    at, spread = (F.array(*map(F.lit, x.tolist()))[F.col("part")] for x in (first, count))
    dealt = placed.select((at + F.pmod(F.xxhash64("id", "v"), spread)).cast("int").alias("cell"), "part", "id", "v")
    # The cells of each part, as a table of parts by cells.
    within = np.zeros((parts, int((first + count).max())), bool)
    for p in np.flatnonzero(sizes):
        within[p, first[p] : first[p] + count[p]] = True

    def probes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            if b.num_rows:
                to = router.probed(flat(b.column(1)))
                probed = np.zeros((b.num_rows, parts), bool)
                probed[np.arange(b.num_rows)[:, None], to] = True
                for c in range(within.shape[1]):
                    own = probed & within[:, c]
                    who = np.flatnonzero(own.any(1))
                    if len(who):
                        wanted = pa.array([np.flatnonzero(x).astype(np.int32) for x in own[who]], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), c, np.int32)), wanted, b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who))], names=["cell", "parts", "id", "v"])

    asked = rows.filter("asked").groupBy("id").agg(F.min("v").alias("v"))
    sent = asked.mapInArrow(probes, "cell int, parts array<int>, id long, v array<double>")

    def ranked(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            every, part, vs = left.column("id").to_numpy(), left.column("part").to_numpy(), flat(left.column("v").combine_chunks())
            asking, qs = right.column("id").to_numpy(), flat(right.column("v").combine_chunks())
            lists = right.column("parts").combine_chunks()
            wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(asking)), np.diff(lists.offsets.to_numpy()))
            for p in np.unique(part):
                ids, v = every[part == p], vs[part == p]
                here = who[wanted == p]
                for i in range(0, len(here), 256):
                    own = here[i : i + 256]
                    s = qs[own] @ v.T
                    s[asking[own][:, None] == ids[None, :]] = -np.inf
                    least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                    a, b = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))
                    exact = (qs[own[a]] * v[b]).sum(1)  # the same rounding wherever a vector stands
                    order = np.lexsort((ids[b], -exact, a))
                    a, b, exact = a[order], b[order], exact[order]
                    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                    out.append((asking[own[a[keep]]], ids[b[keep]], exact[keep]))
        if not out:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((near, -score, query))
        query, near, score = query[order], near[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query_id": query[keep], "id": near[keep], "score": score[keep]})

    found = dealt.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(ranked, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
