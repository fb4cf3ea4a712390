"""Operators over execution traces: records, intervals, counters, and the tables around them.

A record has node, stream, time (long ticks), id, and a type; an interval has begin and end.
Every function takes and returns lazy DataFrames; ties in time are broken by id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Widths of time buckets, in microseconds.
HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Records of a thread in a bucket, where a thread's order is that of places and not of times; and of a key that a task may hold.
PLACES = 1 << 20


def _before(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def width_for(records: DataFrame, keys: list[str], width: int = DAY, most: int = PLACES) -> int | None:
    """``width`` where some key has more than ``most`` records, else None: a task can hold each key's. Counts at once."""
    largest = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return width if (largest or 0) > most else None


def in_buckets(rows: DataFrame, order: str, width: int | None, extra: DataFrame | None = None) -> DataFrame:
    """Rows with their bucket ``_b`` of ``order`` (the one there is, without a width); with the ``extra`` rows, which have one, marked ``_g``."""
    bucket = F.lit(0) if width is None else F.floor(F.col(order) / F.lit(width))
    cut = rows.withColumns({"_b": bucket, "_g": F.lit(False)})
    return cut if extra is None else cut.unionByName(extra.withColumn("_g", F.lit(True)), allowMissingColumns=True)


def _with_edges(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int | None) -> DataFrame:
    """Rows in buckets, and with each bucket the record before it and the one after it.

    A window over the keys and ``_b`` sees each row's neighbours so, and a task holds a
    bucket's rows and not all of a key's. The edge rows have the order and ``columns`` alone.
    """
    if width is None:
        return in_buckets(rows, order[0], None)
    told = F.struct(*dict.fromkeys([*order, *(c for c in columns if c not in keys)]))
    ends = in_buckets(rows, order[0], width).groupBy(*keys, "_b").agg(F.min(told).alias("_first"), F.max(told).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b")
    beside = ends.select(*keys, "_b", F.lag("_last").over(w).alias("_p"), F.lead("_first").over(w).alias("_n"))
    edges = beside.select(*keys, "_b", F.explode(F.array("_p", "_n")).alias("_x")).filter("_x IS NOT NULL").select(*keys, "_b", "_x.*")
    return in_buckets(rows, order[0], width, edges)


def pair_intervals(records: DataFrame, thread: list[str], start: Column, end: Column, same: tuple[str, ...] = (), others: list[str] | None = None, time: str = "time", id: str = "id", order: list[str] | None = None, width: int | None = DAY) -> DataFrame:
    """Starts with their end: ``begin``, and ``end`` or null.

    An end fits a start if it is not earlier and the ``same`` columns agree. A start takes
    the next record of its thread if that is a fitting end. Else it takes the first fitting end
    of its thread that isn't the next record of a start it fits itself; else, where ``others``
    names the columns of a file, such an end of the first other thread of the file that has one.
    An end may serve several starts. ``order`` is that of a thread's records (time, then id).
    Threads are cut into buckets of ``width`` (PLACES, where an order is given), which look
    past their edges; they stay whole where it is None (see width_for).
    """
    by = order or [time, id]
    within = Window.partitionBy(*thread, "_b").orderBy(*by)
    marked = records.withColumns({"_s": F.coalesce(start, F.lit(False)), "_e": F.coalesce(end, F.lit(False))})

    def alike(move) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(move(c)) for c in same), F.lit(True))

    def after(c: str) -> Column:
        return F.lead(c).over(within)

    def before(c: str) -> Column:
        return F.lag(c).over(within)

    direct = F.when(F.col("_s") & after("_e") & alike(after) & (after(time) >= F.col(time)), after(time))
    taken = F.col("_e") & F.coalesce(before("_s") & alike(before) & (before(time) <= F.col(time)), F.lit(False))
    edged = _with_edges(marked, thread, by, [time, id, "_s", "_e", *same], PLACES if order and width else width)
    seen = edged.withColumns({"_d": direct, "_c": F.when(F.col("_e") & ~taken, F.col(time))}).filter("NOT _g").drop("_b", "_g")
    # A bucket ends with the first free end of those after it. Backwards, so that the frame only grows.
    alone = [*thread, *(c for c in same if c not in thread)]
    carried = None
    if width is not None:
        firsts = in_buckets(seen.filter("_c IS NOT NULL OR _s"), time, width).groupBy(*alone, "_b").agg(F.min(F.when(F.col("_c").isNotNull(), F.struct(time, id))).alias("_f"))
        after_it = F.last("_f", ignorenulls=True).over(Window.partitionBy(*alone).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
        carried = firsts.withColumn("_f", after_it).filter("_f IS NOT NULL").select(*alone, "_b", "_f.*", F.col(f"_f.{time}").alias("_c"))
    later = Window.partitionBy(*alone, "_b").orderBy(F.desc(time), F.desc(id)).rowsBetween(Window.unboundedPreceding, -1)
    ended = in_buckets(seen, time, width, carried).withColumn("_n", F.last("_c", ignorenulls=True).over(later)).withColumn("end", F.coalesce("_d", "_n"))
    ended = ended.filter("NOT _g").drop("_b", "_g")
    if others is not None:
        ended = _end_elsewhere(ended, next(c for c in thread if c not in others), list(dict.fromkeys([*others, *same])), time, width or DAY)
    found = ended.filter("_s").withColumn("begin", F.col(time))
    return found.drop("_s", "_e", "_d", "_c", "_n")


def _end_elsewhere(ended: DataFrame, stream: str, keys: list[str], time: str, width: int) -> DataFrame:
    """Starts (``_s``); one without ``end`` takes the next free end (``_c``) of the first other stream of its keys that has one.

    A stream has one if its last free end (with no ``_n`` after it) isn't earlier than the start, so
    the first such stream is a running minimum, backwards in time. The second is kept too, as a
    start's own stream may have an end at the start's very time. No pair is made, and a task holds
    a bucket of the keys; it ends with the next end of the first stream that has one after it.
    """
    sides = F.explode(F.array_compact(F.array(F.when(F.col("_s"), True), F.when(F.col("_c").isNotNull(), False))))
    split = ended.withColumn("_k", sides).withColumns({"_s": F.col("_k"), "_c": F.when(~F.col("_k"), F.col("_c"))}).drop("_k")
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*keys, stream]))
    cut = in_buckets(split, time, width).filter(F.col("_s") | whole).withColumn("_l", F.when(F.col("_c").isNotNull() & F.col("_n").isNull(), F.col(stream)))
    cell = [*keys, "_b"]
    past = Window.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    wanted = cut.groupBy(*cell).agg(F.min("_l").alias("_l")).withColumn(stream, F.min("_l").over(past)).filter(F.col(stream).isNotNull()).select(*cell, stream)
    ends = cut.filter("_c IS NOT NULL").groupBy(*cell, stream).agg(F.min("_c").alias("_c"))
    later = Window.partitionBy(*keys, stream).orderBy(F.desc("_b"), "_w").rowsBetween(Window.unboundedPreceding, -1)
    told = ends.withColumn("_w", F.lit(1)).unionByName(wanted.withColumn("_w", F.lit(0)), allowMissingColumns=True).withColumn("_c", F.min("_c").over(later)).filter("_w = 0")
    carried = told.select(*cell, stream, "_c", F.col("_c").alias(time), F.col(stream).alias("_l"))
    back = Window.partitionBy(*cell).orderBy(F.desc(time))
    upto = (Window.unboundedPreceding, Window.currentRow)
    rows = cut.unionByName(carried.withColumns({"_s": F.lit(False), "_g": F.lit(True)}), allowMissingColumns=True)
    rows = rows.withColumns({"_p": F.min("_l").over(back.rowsBetween(Window.unboundedPreceding, -1)), "_1": F.min("_l").over(back.rangeBetween(*upto))})
    rows = rows.withColumn("_2", F.min(F.when(F.col("_l") != F.col("_p"), F.greatest("_l", "_p"))).over(back.rangeBetween(*upto)))
    lone = F.col("_s") & F.col("end").isNull() & F.col(time).isNotNull()
    takes = F.when(~F.col("_s"), F.col(stream)).when(lone & (F.col("_1") != F.col(stream)), F.col("_1")).when(lone & (F.col("_1") == F.col(stream)), F.col("_2"))
    nearest = F.min("_c").over(Window.partitionBy(*cell, "_t").orderBy(F.desc(time)).rangeBetween(*upto))
    out = rows.withColumn("_t", takes).withColumn("end", F.coalesce("end", F.when(F.col("_t").isNotNull(), nearest)))
    return out.filter("_s").drop("_b", "_g", "_l", "_p", "_1", "_2", "_t")


def validate(records: DataFrame, known: Column, keys: list[str], order: str, time: str = "time", width: int = DAY) -> DataFrame:
    """Records with ``error``: null, 'unknown type', or 'before its predecessor'.

    The predecessor is the largest time so far of a known type on the stream; a bucket of
    ``width`` of the order begins with that of the buckets before.
    """
    marked = records.withColumn("_t", F.when(known, F.col(time)))
    most = in_buckets(marked, order, width).groupBy(*keys, "_b").agg(F.max("_t").alias("_t"), F.max(order).alias(order))
    w = Window.partitionBy(*keys).orderBy("_b")
    starts = most.select(*keys, "_b", F.max("_t").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_t"), F.lag(order).over(w).alias(order)).filter("_t IS NOT NULL")
    past = F.max("_t").over(_before([*keys, "_b"], order))
    told = in_buckets(marked, order, width, starts).withColumn("error", F.when(~known, "unknown type").when(F.col(time) < past, "before its predecessor"))
    return told.filter("NOT _g").drop("_b", "_g", "_t")


def interval_errors(intervals: DataFrame, longest: int | None = None) -> DataFrame:
    """Intervals with ``error``: null, 'no matching end', or 'unreasonable duration'."""
    bad = F.col("end") < F.col("begin")
    if longest is not None:
        bad = bad | (F.col("end") - F.col("begin") > longest)
    return intervals.withColumn("error", F.when(F.col("end").isNull(), "no matching end").when(bad, "unreasonable duration"))


def count_by_node(events: DataFrame, type: str, node: str, nodes: list) -> DataFrame:
    """A row for each type with a count for each node (0 if none)."""
    return events.groupBy(type).agg(*(F.count(F.when(F.col(node) == n, 1)).alias(f"node_{n}") for n in nodes))


def quantiles(events: DataFrame, by: str, value: str, wanted: dict[str, float], width: int) -> DataFrame:
    """Exact interpolated quantiles of a whole-number column: a row for each group that has a value.

    Distinct values are counted and added up in buckets of ``width``, so no task holds a group.
    """
    counts = events.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_totals(counts, [by], {"_upto": "_n"}, [value], width)
    rows = upto.join(counts.groupBy(by).agg(F.sum("_n").alias("_all")), by)
    at = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    sides = [F.min(F.when(F.col("_upto") > side(place), F.col(value))).alias(f"_{tag}_{name}") for name, place in at.items() for tag, side in (("a", F.floor), ("b", F.ceil))]
    out = rows.groupBy(by).agg(F.max("_all").alias("_all"), *sides)
    return out.select(by, *((F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * (p - F.floor(p))).alias(n) for n, p in at.items()))


def describe(events: DataFrame, by: str, value: str, width: int = 1000) -> DataFrame:
    """Count, mean, standard deviation (n - 1; null for one row), least, quartiles and largest of a whole-number value."""
    wide = F.col(value).cast("decimal(20,0)")
    sums = events.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("_s"), F.sum(wide * wide).cast("double").alias("_s2"), F.min(value).alias("least"), F.max(value).alias("largest"))
    var = (F.col("_s2") - F.col("_s").cast("double") * F.col("_s") / F.col("n")) / (F.col("n") - 1)
    std = F.when(F.col("n") > 1, F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 3))
    quarts = quantiles(events, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, width)
    mean = F.when(F.col("n") > 0, F.col("_s").cast("double") / F.col("n"))
    return sums.join(quarts, by, "left").select(by, "n", mean.alias("mean"), std.alias("std"), "least", "q1", "median", "q3", "largest")


def spread(events: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, variance (n - 1, but n for one row) and relative standard deviation in whole percent of a long value.

    Sums are exact, so the result is the same in any order of rows.
    """
    wide = F.col(value).cast("decimal(20,0)")
    sums = events.groupBy(by).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(wide * wide).cast("double").alias("s2"))
    square = F.col("s").cast("double") * F.col("s") / F.col("n")
    var = F.when(F.col("n") > 1, (F.col("s2") - square) / (F.col("n") - 1)).otherwise(0.0)
    mean = F.col("s") / F.col("n")
    return sums.select(by, "n", mean.alias("mean"), F.round(var, 3).alias("variance"), (100 * F.sqrt(F.greatest(var, F.lit(0.0))) / mean).cast("long").alias("rsd"))


def extents(records: DataFrame, intervals: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Begin, end and duration of each stream: from its least accepted record, ends included, to the largest end of a valid interval (0 if none)."""
    first = records.groupBy(*keys).agg(F.min(time).alias("begin"))
    last = intervals.groupBy(*keys).agg(F.max("end").alias("end"))
    out = first.join(last, keys, "left").withColumn("end", F.coalesce("end", F.lit(0).cast("long")))
    return out.withColumn("duration", F.col("end") - F.col("begin"))


def common_information(info: DataFrame, node: str = "node", key: str = "key", value: str = "value", first: int = 0) -> DataFrame:
    """The first node's keys whose value no other node contradicts; a node without the key or with value 0 doesn't."""
    own = F.col(node) == first
    other = F.when(~own & (F.col(value) != 0), F.col(value))
    seen = info.groupBy(key).agg(F.max(F.when(own, F.col(value))).alias("_v"), F.min(other).alias("_a"), F.max(other).alias("_b"))
    kept = seen.filter("_v IS NOT NULL AND (_a IS NULL OR (_a = _v AND _b = _v))")
    return kept.select(key, F.col("_v").alias(value))


def merge_information(info: DataFrame, runs: int, key: str = "key", value: str = "value") -> DataFrame:
    """Of the keys that all runs have: the value where equal, else the mean."""
    out = info.groupBy(key).agg(F.countDistinct("run").alias("r"), F.min(value).alias("a"), F.max(value).alias("b"), F.avg(value).alias("m"))
    return out.filter(F.col("r") == runs).select(key, F.when(F.col("a") == F.col("b"), F.col("a").cast("double")).otherwise(F.col("m")).alias(value), (F.col("a") == F.col("b")).alias("equal"))


def running_totals(changes: DataFrame, keys: list[str], totals: dict[str, str], order: list[str], width: int) -> DataFrame:
    """Running totals ``{new column: changes}`` in an order that begins with a time; rows without a key or time are left out.

    Time is cut into buckets of ``width``, and a bucket starts from the sums of those before,
    so a task holds a bucket's rows and not all of a key's.
    """
    cut = changes.withColumn("_b", F.floor(F.col(order[0]) / F.lit(width)))
    sums = cut.groupBy(*keys, "_b").agg(*(F.sum(c).alias(f"_0{n}") for n, c in totals.items()))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_b", *(F.coalesce(F.sum(f"_0{n}").over(past), F.lit(0)).alias(f"_0{n}") for n in totals))
    inside = _upto([*keys, "_b"], *order)
    joined = cut.join(starts, [*keys, "_b"])
    return joined.select(*changes.columns, *((F.col(f"_0{n}") + F.sum(c).over(inside)).alias(n) for n, c in totals.items()))


def running_total(changes: DataFrame, keys: list[str], change: str, time: str = "time", id: str = "id", width: int = HOUR) -> DataFrame:
    """``total`` after each change."""
    return running_totals(changes, keys, {"total": change}, [time, id] if id != time else [time], width)


def memory_timeline(events: DataFrame, keys: list[str], pointer: str, allocates: Column, size: str, time: str = "time", id: str = "id", width: int = HOUR) -> DataFrame:
    """Memory in use after each allocation and each matched free, as ``change`` and ``total``.

    A free gives back what the event before it with its pointer allocated; a free that follows
    another free, or nothing, has no row; allocations of size 0 are passed over.
    """
    kept = events.withColumn("_m", allocates).filter(~F.col("_m") | (F.col(size) > 0))
    w = Window.partitionBy(*keys, pointer, "_b").orderBy(time, id)
    freed = F.when(F.lag("_m").over(w), -F.lag(size).over(w))
    edged = _with_edges(kept, [*keys, pointer], [time, id], ["_m", size], 24 * width)
    changes = edged.withColumn("change", F.when(F.col("_m"), F.col(size)).otherwise(freed)).filter("change IS NOT NULL AND NOT _g").drop("_m", "_b", "_g")
    return running_total(changes, keys, "change", time, id, width)


def counter_timeline(intervals: DataFrame, keys: list[str], size: str, width: int = HOUR) -> DataFrame:
    """+size at each begin and -size at each end, with the running total."""
    sides = F.explode(F.array(F.struct(F.col("begin").alias("time"), F.lit(0).alias("side"), F.col(size).alias("change")), F.struct(F.col("end").alias("time"), F.lit(1).alias("side"), (-F.col(size)).alias("change"))))
    rows = intervals.select(*keys, "id", sides.alias("x")).select(*keys, "id", "x.*")
    return running_totals(rows, keys, {"total": "change"}, ["time", "side", "id"], width)


def next_match(records: DataFrame, keys: list[str], columns: list[str], time: str = "time", id: str = "id", width: int | None = DAY) -> DataFrame:
    """Each record with ``next_<column>`` of the record after it with the same keys, which are cut into buckets of ``width`` (whole if None)."""
    w = Window.partitionBy(*keys, "_b").orderBy(time, id)
    edged = _with_edges(records, keys, [time, id], columns, width)
    return edged.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("NOT _g").drop("_b", "_g")


def clip(intervals: DataFrame, keys: list[str], width: int = HOUR) -> DataFrame:
    """Intervals without what earlier ones of their keys cover already; wholly covered ones go.

    The largest end so far is that of the time buckets before, and of the rows before in the bucket.
    """
    cut = intervals.withColumn("_b", F.floor(F.col("begin") / F.lit(width)))
    most = cut.groupBy(*keys, "_b").agg(F.max("end").alias("_m"))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = most.select(*keys, "_b", F.max("_m").over(past).alias("_m"))
    seen = cut.join(ends, [*keys, "_b"]).withColumn("_c", F.greatest("_m", F.max("end").over(_before([*keys, "_b"], "begin", "id"))))
    return seen.filter(F.col("_c").isNull() | (F.col("end") > F.col("_c"))).withColumn("begin", F.greatest("begin", F.coalesce("_c", F.col("begin")))).drop("_c", "_b", "_m")


def derivative(points: DataFrame, keys: list[str], x: str, y: str, least: float = 1e-4, width: float = 3600) -> DataFrame:
    """dy/dx of neighbours; null for the first and where x hardly moves. A bucket's first point follows the last of the bucket before."""
    cut = points.withColumn("_b", F.floor(F.col(x) / F.lit(width)))
    lasts = cut.groupBy(*keys, "_b").agg(F.max(F.struct(x, "id", y)).alias("_l"))
    before = lasts.select(*keys, "_b", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias("_l"))
    w = Window.partitionBy(*keys, "_b").orderBy(x, "id")
    joined = cut.join(before, [*keys, "_b"])
    dx, dy = (F.col(c) - F.coalesce(F.lag(c).over(w), F.col("_l")[c]) for c in (x, y))
    return joined.withColumn("slope", F.when(F.abs(dx) > least, dy / dx)).drop("_b", "_l")


def occurrences(events: DataFrame, keys: list[str], most: int, time: str = "time", id: str = "id") -> DataFrame:
    """The first ``most`` records of each key, numbered from 1."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(time, id))).filter(F.col("nth") <= most)


def overlap_pairs(intervals: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs (id, other) of intervals of one key that touch: a.begin <= b.end and b.begin <= a.end.

    Time is cut into buckets of ``width``; intervals meet in the buckets they reach, and a
    pair is made in the first bucket that both reach.
    """
    cut = intervals.select(*keys, "id", "begin", "end", F.floor(F.col("begin") / width).alias("_f"), F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))).alias("_b"))
    other = cut.select(*keys, "_b", *(F.col(c).alias(f"o{c}") for c in ("id", "begin", "end", "_f")))
    met = cut.join(other, [*keys, "_b"]).filter("id < oid AND begin <= oend AND obegin <= end AND _b = greatest(_f, o_f)")
    return met.select(*keys, "id", F.col("oid").alias("other"))


def contained(intervals: DataFrame, outer: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Intervals that begin inside an outer one of their key, and whether they end inside it."""
    big = outer.select(*keys, F.col("id").alias("outer"), F.col("begin").alias("_ob"), F.col("end").alias("_oe"), F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))).alias("_b"))
    own = intervals.withColumn("_b", F.floor(F.col("begin") / width))
    return own.join(big, [*keys, "_b"]).filter("begin BETWEEN _ob AND _oe").select(*keys, "id", "outer", (F.col("end") <= F.col("_oe")).alias("whole"))


def attribute_overlap(tasks: DataFrame, counters: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Counts of counter intervals shared out to the tasks they overlap, in proportion, cut to whole numbers.

    A counter has begin, end and delta; one without length counts for nothing.
    """
    def reach(df: DataFrame) -> Column:
        return F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width)))

    t = tasks.select(*keys, F.col("id").alias("task"), F.col("begin").alias("tb"), F.col("end").alias("te"), reach(tasks).alias("_b"))
    c = counters.filter("end > begin").select(*keys, "id", F.col("begin").alias("cb"), F.col("end").alias("ce"), "delta", reach(counters).alias("_b"))
    met = t.join(c, [*keys, "_b"]).filter(f"cb < te AND ce > tb AND _b = greatest(floor(tb / {width}), floor(cb / {width}))")
    share = (F.least("ce", "te") - F.greatest("cb", "tb")).cast("double") / (F.col("ce") - F.col("cb"))
    return met.select("task", (share * F.col("delta")).cast("long").alias("n")).groupBy("task").agg(F.sum("n").alias("counted"))


def match_messages(messages: DataFrame, keys: list[str], kind: str, sent: str, received: str) -> DataFrame:
    """A row for each send and each of its receives."""
    sends = messages.filter(F.col(kind) == sent).select(*keys, F.col("id").alias("send"), F.col("time").alias("sent_at"))
    receives = messages.filter(F.col(kind) == received).select(*keys, F.col("id").alias("receive"), F.col("time").alias("received_at"))
    return sends.join(receives, keys)


def filter_events(events: DataFrame, *conditions: str) -> DataFrame:
    """Rows that hold every ``column==value``; values are compared in the column's own type, never evaluated."""
    out = events
    for c in conditions:
        name, sep, value = c.partition("==")
        if not sep or name.strip() not in events.columns:
            raise ValueError(f"not a condition on a column: {c}")
        out = out.filter(F.col(name.strip()) == F.lit(value.strip()).cast(events.schema[name.strip()].dataType))
    return out


def name_matches(column: str, pattern: str) -> Column:
    """/pattern/ is searched for; anything else must be the whole name."""
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return F.col(column).rlike(pattern[1:-1])
    return F.col(column).rlike(f"^(?:{re.escape(pattern)})$")


def columns_from(df: DataFrame, first: str) -> DataFrame:
    """The columns from ``first`` on."""
    return df.select(*df.columns[df.columns.index(first) :])


def build_events(raw: DataFrame, known: Column, longest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, errors) of raw records: node_id, stream_id, position, type, is_end, flags, taskpool_id, event_id, timestamp.

    A record of an unknown type, or before its predecessor, is an error. A start that is
    neither becomes an event with its end; it is an error without one, or if it ends before
    it begins or lasts longer than ``longest``. Ends make no rows of their own.
    """
    thread = ["node_id", "stream_id"]
    checked = validate(raw, known, thread, "position", "timestamp", PLACES)
    paired = pair_intervals(checked, thread, ~F.col("is_end"), F.col("is_end"), ("type", "event_id", "taskpool_id"), ["node_id"], "timestamp", "position", ["position"])
    took = F.col("end") - F.col("begin")
    bad = (took < 0) if longest is None else (took < 0) | (took > longest)
    told = paired.filter("error IS NULL").withColumn("error", F.when(F.col("end").isNull(), "no matching end").when(bad, "unreasonable duration"))
    own = [*thread, "position", "taskpool_id", "type", "begin", "end", "flags", F.col("event_id").alias("id")]
    refused = checked.filter("error IS NOT NULL").withColumns({"begin": F.col("timestamp"), "end": F.lit(None).cast("long")})
    errors = told.filter("error IS NOT NULL").select(*own, F.col("error").alias("error_msg")).unionByName(refused.select(*own, F.col("error").alias("error_msg")))
    return told.filter("error IS NULL").select(*own), errors


def with_errors(events: DataFrame, errors: DataFrame) -> DataFrame:
    """Events and errors in one table; an event's error_msg is null."""
    return events.unionByName(errors, allowMissingColumns=True)


def check_messages(events: DataFrame, wanted: dict[str, tuple[int, int]], type: str = "type", size: str = "msg_size") -> DataFrame:
    """(type, n, bytes, fine): how many messages of each wanted type there are and their size, and whether that is as wanted."""
    got = events.filter(F.col(type).isin(*wanted)).groupBy(type).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    n, total = (F.coalesce(*(F.when(F.col(type) == t, F.lit(w[k])) for t, w in wanted.items())) for k in (0, 1))
    return got.withColumn("fine", (F.col("n") == n) & (F.col("bytes") == total))


def group_runs(nodes: DataFrame, by: tuple[str, ...] = ("worldsize", "SYNC_TIME_ELAPSED", "cwd", "exe"), file: str = "filename") -> DataFrame:
    """Files that belong to one run: a row for each combination of what tells runs apart; a file stands in one only."""
    have = [c for c in by if c in nodes.columns]
    return nodes.groupBy(*have).agg(F.array_sort(F.collect_set(file)).alias("files"), F.count(F.lit(1)).alias("n"))


def merge_runs(runs: dict[int, DataFrame]) -> DataFrame:
    """Runs one below the other, each with its start_time; a column that a run lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("start_time", F.lit(t)) for t, df in runs.items()))


def latest_by_process(points: DataFrame) -> DataFrame:
    """Per process: sum of the units' latest y and mean of their latest x."""
    last = points.groupBy("process", "unit").agg(F.max_by("y", F.struct("x", "id")).alias("y"), F.max("x").alias("x"))
    return last.groupBy("process").agg(F.sum("y").alias("y"), F.avg("x").alias("x"))
