"""Texts whose word-shingle sets have a Jaccard similarity of 0.8 or more, and their components.

1. Equal sets become one: within a batch as it is read, then over all batches.
2. A round (see rounds.py) counts in how many sets each shingle stands. Rarer ones come first
   in the global order of shingles, by which prefixes are taken; equal counts (to a power of
   two) are in the order of names. A set with too many shingles of its own can have no
   partner and is done.
3. The others are linked to one pivot each that minimal hashes suggest, where that is right.
   It only saves work: documents that are connected already needn't be compared.
4. Adaptive multi-match prefixes do the rest. A document's prefix is lengthened by the step
   of STEPS that costs least by what its lists hold, and a pair must share as many more
   prefix shingles. A shingle's places in two sets bound how much they can share from there
   on, so an entry stays in a list only while some entry of another label could be its
   partner. In a group of near copies those that aren't similar have rare shingles before
   the group's common ones, so their entries leave the group's lists before any pair is made.
   What stays is linked to a pivot of each list first, and then pair by pair, verified.

Shingles are compared by 48-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import cut, gram_hashes, mix, partitions, utf8, word_hashes, words
from weftspark.llm.rounds import ask, differences, keep_rows, kept_rows, squeeze, stretch
from weftspark.llm.substrings import _frame

#: Words in a shingle; the similarity as a fraction; bits of a shingle's name.
SHINGLE, OVER, UNDER, BITS = 5, 4, 5, 48
#: Bands of minimal hashes for pivots, rows of a pivot that meet in one place, entries of a list that meet in one place.
BANDS, PLACE, BLOCK = 8, 128, 1024
#: Shingles that a prefix may gain.
STEPS = (0, 1, 2, 4, 8)
#: Parts that the rows of one key are dealt to when they meet a table with a row per key.
DEAL = 16


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct shingles of all texts, sorted within a text, and the texts' n + 1 offsets."""
    raw, offsets = utf8(column)
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends, lower=True)
    count = np.diff(at)
    text = np.repeat(np.arange(len(count)), count)
    g = gram_hashes(h, SHINGLE)
    inside = np.arange(len(g)) + SHINGLE <= at[text[: len(g)] + 1] if len(g) else np.zeros(0, bool)
    name, owner = g[inside], text[: len(g)][inside]
    for m in range(1, SHINGLE):  # a shorter text is one shingle
        short = np.flatnonzero(count == m)
        if len(short):
            name = np.concatenate([name, gram_hashes(h, m, m)[at[short]]])
            owner = np.concatenate([owner, short])
    name = name >> np.uint64(64 - BITS)
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
    name, owner = name[new], owner[new]
    return name, np.searchsorted(owner, np.arange(len(count) + 1))


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _scatter(batch: pa.RecordBatch, ranges: int) -> tuple[bytes, dict[int, bytes]]:
    order = np.argsort(batch.column(0).to_numpy(), kind="stable")
    batch = batch.take(pa.array(order))
    name, at = shingle_sets(batch.column(1))
    n = np.diff(at)
    prints = [_sums(mix(name + np.uint64(s)), at) for s in (1, 2)]
    # Of equal sets in the batch the smallest id stands for all.
    by = np.lexsort((np.arange(len(n)), prints[1], prints[0], n))
    new = np.ones(len(n), bool)
    new[1:] = (n[by[1:]] != n[by[:-1]]) | (prints[0][by[1:]] != prints[0][by[:-1]]) | (prints[1][by[1:]] != prints[1][by[:-1]])
    rep = np.empty(len(n), int)
    rep[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))]
    owner = np.repeat(np.arange(len(n)), n)
    use = rep[owner] == owner
    name, owner = name[use], owner[use]
    by = np.argsort(name, kind="stable")
    name, owner = name[by], owner[by]
    # A shingle of two sets in the batch is sent once, marked; the batch keeps which sets those are.
    head = np.ones(len(name), bool)
    head[1:] = name[1:] != name[:-1]
    many = np.zeros(len(name), bool)
    many[1:] |= ~head[1:]
    many[:-1] |= ~head[1:]
    rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(rep), *(pa.array(p) for p in prints)], names=["id", "n", "rep", "p0", "p1"])
    kept = squeeze(differences(name[many]), owner[many]) + keep_rows(rows)
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(name)))
    name, owner = name[at], np.where(many[at], len(n), owner[at])
    cuts = np.searchsorted(name // np.uint64(-(-(1 << BITS) // ranges)), np.arange(ranges + 1))
    sent = {i: squeeze(differences(name[a:b]), owner[a:b], count[a:b], np.array([len(n)])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a}
    return kept, sent


def _reduce(blobs: list[bytes]) -> list[bytes | None]:
    """For each batch, those of its shingles that stand in two sets or more: name, owner, and the count's power of two."""
    if not blobs:
        return []
    names, owners, counts = [], [], []
    for blob in blobs:
        name, owner, count, _ = stretch(blob)
        names.append(np.cumsum(name))
        owners.append(owner.astype(np.uint32))
        counts.append(count.astype(np.uint32))
    every = np.concatenate(names)
    by = np.argsort(every, kind="stable")
    new = np.ones(len(every), bool)
    new[1:] = every[by[1:]] != every[by[:-1]]
    at = np.flatnonzero(new)
    total = np.add.reduceat(np.concatenate(counts)[by], at, dtype=np.int64)
    power = np.zeros(len(every), np.uint8)
    power[by] = np.repeat(np.ceil(np.log2(total)).astype(np.uint8), np.diff(np.append(at, len(every))))
    out: list[bytes | None] = []
    at = 0
    for name, owner in zip(names, owners, strict=True):
        mine = power[at : at + len(name)]
        at += len(name)
        own = mine > 0
        out.append(squeeze(differences(name[own]), owner[own], mine[own]) if own.any() else None)
    return out


def _gather(kept: bytes, answers: list[bytes]) -> pa.Table:
    size = _frame(kept)
    rows = kept_rows(kept[size:])
    ids, n, rep = (rows.column(i).to_numpy() for i in range(3))
    parts = [stretch(a) for a in answers]
    name, owner, power = (np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(p[i]) if i == 0 else p[i] for p in parts)]) for i in range(3))
    # Shingles of several sets of the batch: the answer has the power, what was kept has the sets.
    marked = np.flatnonzero(owner == len(ids))
    marked = marked[np.argsort(name[marked], kind="stable")]
    own_name, own = stretch(kept[:size])
    own_name = np.cumsum(own_name)
    own_power = power[marked][np.searchsorted(name[marked], own_name)]
    single = owner < len(ids)
    name, owner, power = (np.concatenate(x) for x in ((name[single], own_name), (owner[single], own), (power[single], own_power)))
    name, owner = power << np.uint64(BITS) | name, owner.astype(np.int64)
    order = np.lexsort((name, owner))
    name, owner = name[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(ids) + 1))
    shared = np.diff(at)
    # How common a set's shingles are on the whole; in a group of copies the original's are commonest.
    common = _sums((name >> np.uint64(BITS)).astype(np.int64), at) * 1024 // np.maximum(n, 1)
    names = [squeeze(differences(name[at[i] : at[i + 1]])) if rep[i] == i and n[i] and UNDER * shared[i] >= OVER * n[i] else None for i in range(len(ids))]
    columns = {"id": ids, "rep": ids[rep], "n": n, "lone": n - shared, "common": common}
    return pa.table([*map(pa.array, columns.values()), rows.column(3).cast(pa.int64(), safe=False), rows.column(4).cast(pa.int64(), safe=False), pa.array(names, pa.binary())], names=[*columns, "p0", "p1", "names"])


def _dealt_join(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """Join to a narrow table with a row per key, where a key may have a large share of the rows."""
    copies = one.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    return rows.withColumn("_d", F.pmod(F.xxhash64(by), F.lit(DEAL)).cast("int")).join(copies, [key, "_d"]).drop("_d")


def _bands(sets: DataFrame) -> DataFrame:
    """(key, id, common): bands of minimal hashes of the shared shingles."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            keys, ids, common = [], [], []
            for i, how, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = mix(np.cumsum(stretch(blob)[0]))
                least = np.full(2 * BANDS, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, (x >> np.uint64(60)).astype(np.int64) % (2 * BANDS), x)
                both = mix(least[::2] * np.uint64(31) + least[1::2] + np.arange(BANDS, dtype=np.uint64))
                keys.append(both)
                ids += [i] * BANDS
                common += [how] * BANDS
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids, pa.int64()), pa.array(common, pa.int64())], names=["key", "id", "common"])

    return sets.select("id", "common", "names").mapInArrow(run, "key long, id long, common long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar. Many pairs may have one b: they are dealt to several places."""
    spark = pairs.sparkSession
    places = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PLACE).cast("int").alias("places"))
    dealt = _dealt_join(pairs, places, "b", "a").withColumn("place", F.pmod(F.xxhash64("a"), F.col("places")).cast("int"))
    bucket = F.pmod(F.xxhash64("b", "place"), F.lit(4 * partitions(spark))).cast("int").alias("bucket")
    left = dealt.join(sets.select(F.col("id").alias("a"), "n", "names"), "a").select(bucket, "a", "b", "n", "names")
    copies = places.join(sets.select(F.col("id").alias("b"), "n", "names"), "b").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    right = copies.select(bucket.alias("to"), F.col("b").alias("pivot"), F.col("n").alias("size"), F.col("names").alias("own"))

    def verify(x: pa.Table, y: pa.Table) -> pa.Table:
        sets = {b: (n, np.cumsum(stretch(s)[0])) for b, n, s in zip(*(y.column(c).to_pylist() for c in ("pivot", "size", "own")), strict=True)}
        out = []
        for a, b, n, s in zip(*(x.column(c).to_pylist() for c in ("a", "b", "n", "names")), strict=True):
            m, other = sets[b]
            own = np.cumsum(stretch(s)[0])
            i = np.searchsorted(other, own)
            both = int((other[np.minimum(i, len(other) - 1)] == own).sum())
            if UNDER * both >= OVER * (n + m - both):
                out.append((a, b))
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return left.groupBy("bucket").cogroup(right.groupBy("to")).applyInArrow(lambda x, y: verify(x, y), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest vertex that each vertex of some edge is connected to.

    Labels spread along edges and then jump to their labels' labels, until none changes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        spread = labels.join(near, "id").select("id", F.least("label", "near").alias("next"), "label")
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        new = cut(spread.join(up, "next").select("id", F.least("next", "above").alias("label"), (F.least("next", "above") != F.col("label")).alias("moved")))
        labels = new.select("id", "label")
        if not new.filter("moved").limit(1).count():
            return labels


def _prefixes(sets: DataFrame) -> DataFrame:
    """(name, id, label, n, common, at, need): the shingles of the longest prefixes, their places in the set, and how long the shortest is."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            columns = [[] for _ in range(7)]
            for i, label, n, lone, common, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                need = n - -(-OVER * n // UNDER) + 1
                x = np.cumsum(stretch(blob)[0])[: max(0, need + STEPS[-1] - lone)]
                for c, v in zip(columns, (x.astype(np.int64), i, label, n, common, lone + np.arange(len(x)), need), strict=True):
                    c.append(v if isinstance(v, np.ndarray) else np.full(len(x), v, np.int64))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["name", "id", "label", "n", "common", "at", "need"])

    return sets.select("id", "label", "n", "lone", "common", "names").mapInArrow(run, "name long, id long, label long, n long, common long, at long, need long")


def _bounds(found: DataFrame) -> DataFrame:
    """Per list, which all have two labels or more: the least n and the greatest reach, the label of each, and the best among other labels."""
    by_label = found.groupBy("name", "label").agg(F.min("n").alias("low"), F.max("reach").alias("high"))
    low = [F.min_by("label", F.struct("low", "label")).alias("small_label"), F.min("low").alias("small")]
    high = [F.max_by("label", F.struct("high", "label")).alias("far_label"), F.max("high").alias("far")]
    both = by_label.join(by_label.groupBy("name").agg(*low, *high), "name")
    others = [F.min(F.when(F.col("label") != F.col("small_label"), F.col("low"))).alias("small_other"), F.max(F.when(F.col("label") != F.col("far_label"), F.col("high"))).alias("far_other")]
    return both.groupBy("name", "small_label", "small", "far_label", "far").agg(*others)


def _of_others(name: str) -> Column:
    return F.when(F.col("label") == F.col(f"{name}_label"), F.col(f"{name}_other")).otherwise(F.col(name))


def _entries(sets: DataFrame) -> DataFrame:
    """(name, id, label, n, common, rest, longer): the prefix entries that may have a partner of another label.

    Sets of n and m shingles are similar if they share 4 (n + m) / 9. From a set's shingle at
    a place ``rest`` are left, and ``longer`` may have been shared before, so the partner's m
    is at most (9 (rest + longer) - 4 n) / 4; that is (reach + 9 longer) / 4.
    """
    listed = _prefixes(sets).withColumn("rest", F.col("n") - F.col("at")).withColumn("reach", 9 * F.col("rest") - 4 * F.col("n"))
    count = F.count(F.lit(1)).alias("length")
    lists = listed.groupBy("name").agg(count, F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("name", "length")
    found = cut(_dealt_join(listed, lists, "name", "id"))
    # The driver keeps and reports a plan again with each of its stages, so what is read twice is written first.
    bounded = _dealt_join(found, cut(_bounds(found)), "name", "id")
    fits = {k: (4 * _of_others("small") <= F.col("reach") + 9 * k) & (4 * F.col("n") <= _of_others("far") + 9 * k) for k in STEPS}
    # Cost of a prefix: its entries are sent, and each list may hold as many candidates, of which fewer stay with more matches asked for.
    costs = [F.sum(F.when((F.col("at") < F.col("need") + k) & fits[k], 1.0 + (F.col("length") - 1) * (1.0 + 8.0 / (1 + k) ** 2)).otherwise(0.0)).alias(f"c{k}") for k in STEPS]
    cost = bounded.groupBy("id").agg(*costs)
    least = F.least(*(F.col(f"c{k}") for k in STEPS))
    longer = F.coalesce(*(F.when(F.col(f"c{k}") <= least, F.lit(k)) for k in STEPS))
    chosen = bounded.join(cost.select("id", longer.alias("longer")), "id")
    fit = F.coalesce(*(F.when(F.col("longer") == k, fits[k]) for k in STEPS))
    return cut(chosen.filter((F.col("at") < F.col("need") + F.col("longer")) & fit).select("name", "id", "label", "n", "common", "rest", "longer"))


def _stars(entries: DataFrame) -> DataFrame:
    """Pairs (a, b): each entry with the pivot of its list, where their labels differ."""
    pivots = entries.groupBy("name").agg(F.max_by(F.struct("id", "label"), F.struct("common", F.col("rest"), -F.col("id"))).alias("p")).select("name", F.col("p.id").alias("b"), F.col("p.label").alias("to"))
    return _dealt_join(entries.select("name", F.col("id").alias("a"), "label"), pivots, "name", "a").filter(F.col("label") != F.col("to")).select("a", "b").distinct()


def candidates(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) with different labels that share enough prefix shingles at places that allow it.

    A list of more than BLOCK entries is dealt to blocks, and each two blocks meet in a place of their own.
    """
    blocks = entries.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("name", "blocks")
    own = _dealt_join(entries, blocks, "name", "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    bucket = F.pmod(F.xxhash64("name", "low", "high"), F.lit(4 * partitions(entries.sparkSession))).cast("int").alias("bucket")

    def pairs(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_numpy() for c in ("name", "low", "high", "n", "id", "label", "rest", "longer", "block")]
        order = np.lexsort(columns[4::-1])
        name, low, high, n, ids, label, rest, longer, block = (x[order] for x in columns)
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(name))[np.cumsum(new) - 1]
        reach = (9 * (rest + longer) - 4 * n) // 4
        out = []
        for i in range(len(name)):
            # Those after it in its place, which is sorted by size, up to the largest partner it may have.
            j = np.arange(i + 1, i + 1 + np.searchsorted(n[i + 1 : ends[i]], reach[i], "right"))
            fine = (label[j] != label[i]) & (9 * (np.minimum(rest[j], rest[i]) + np.minimum(longer[j], longer[i])) >= 4 * (n[j] + n[i]))
            if low[i] != high[i]:
                fine &= block[j] != block[i]
            j = j[fine]
            if len(j):
                out.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), np.minimum(longer[i], longer[j]) + 1))
        if not out:
            return pa.table([pa.array([], pa.int64())] * 4, names=["a", "b", "need", "n"])
        a, b, need = (np.concatenate(x) for x in zip(*out, strict=True))
        key, first, count = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True, return_counts=True)
        return pa.table([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(need[first].astype(np.int64)), pa.array(count)], names=["a", "b", "need", "n"])

    dealt = met.select(bucket, "name", "low", "high", "block", "id", "label", "n", "rest", "longer")
    made = dealt.groupBy("bucket").applyInArrow(pairs, "a long, b long, need long, n long")
    return made.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need")).filter("n >= need").select("a", "b")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row; runs at once.

    Words are runs of other than ASCII white space, A-Z lower-cased. Fewer than 5 words are
    one shingle; null, empty and wordless texts have none and are linked with nothing. Rows
    with a null id are left out, as nothing can name them; rows of one id are taken as
    linked if their texts are. Other columns play no part; an empty table gives no rows. A
    very long text is taken whole, in one batch. Of equally common pivots the smallest id is
    taken; which pivot it is doesn't change the result.
    """
    rows = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, rep long, n long, lone long, common long, p0 long, p1 long, names binary"
    told = cut(ask(rows, "text", _scatter, _reduce, _gather, schema))
    # Equal sets of different batches.
    reps = told.filter("id = rep and n > 0")
    first = reps.groupBy("n", "p0", "p1").agg(F.min("id").alias("class"))
    classes = reps.select("n", "p0", "p1", F.col("id").alias("rep")).join(first, ["n", "p0", "p1"]).select("rep", "class").distinct()
    sets = reps.filter("names is not null").join(first.select(F.col("class").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    sets = cut(sets.select("id", "n", "lone", "common", "names"))
    keys = cut(_bands(sets).distinct())
    pivots = keys.groupBy("key").agg(F.max(F.struct("common", -F.col("id"))).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", (-F.col("p.col2")).alias("b"))
    votes = _dealt_join(keys, pivots, "key", "id").filter("id <> b").groupBy("id", "b").count()
    near = votes.groupBy("id").agg(F.max(F.struct("count", -F.col("b"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b"))
    linked = cut(_similar(cut(near), sets))
    labels = components(linked)
    for pairs in (_stars, candidates):
        labelled = sets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        more = cut(_similar(cut(pairs(_entries(labelled))), sets))
        if more.limit(1).count():
            linked = linked.unionByName(more)
            labels = components(linked)
    named = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("rep", F.coalesce("label", "class").alias("component"))
    out = told.select("id", "rep", "n").join(named, "rep", "left")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
