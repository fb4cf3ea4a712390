"""Task graphs as tables: tasks with integer places, edges between them, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftspark.operators.trace import PLACES, in_buckets


def task_space(spark: SparkSession, **ranges: str | tuple) -> DataFrame:
    """A row for each place in nested ranges ``name=(first, last[, step])``, last included; bounds may be expressions of names before."""
    df = spark.range(1).select(F.lit(0).alias("_"))
    for name, (first, last, *step) in ranges.items():
        df = df.withColumn(name, F.explode(F.expr(f"CASE WHEN cast({first} as long) <= cast({last} as long) THEN sequence(cast({first} as long), cast({last} as long), cast({step[0] if step else 1} as long)) ELSE array() END")))
    return df.drop("_")


def guarded(tasks: DataFrame, *deps: tuple[str, dict[str, str]]) -> DataFrame:
    """Edges (flow, and the other end's places) of each task by (guard, {column: expression}), where the guard holds."""
    rows = [tasks.filter(guard).select(*tasks.columns, F.lit(k).alias("flow"), *(F.expr(e).cast("long").alias(c) for c, e in to.items())) for k, (guard, to) in enumerate(deps)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def fan_out(tasks: DataFrame, name: str, first: str, last: str, step: str = "1") -> DataFrame:
    """An edge for each target of a range that may depend on the task."""
    return tasks.withColumn(name, F.explode(F.expr(f"CASE WHEN {first} <= {last} THEN sequence(cast({first} as long), cast({last} as long), cast({step} as long)) ELSE array() END")))


def gathered(edges: DataFrame, target: str) -> DataFrame:
    """How many control edges each target waits for."""
    return edges.groupBy(target).agg(F.count(F.lit(1)).alias("waits"))


def infer_dependencies(accesses: DataFrame, tile: str = "tile", seq: str = "seq", op: str = "op", width: int = PLACES) -> DataFrame:
    """Edges (src, dst, tile, kind) that an order of accesses to tiles implies.

    ``op`` is R, W or RW. Reads follow the last write (RAW), a write follows the write
    before (WAW) and the reads since then (WAR). The order is cut into buckets of ``width``,
    each with the write before it and the one after, so no task holds all of a tile's accesses.
    """
    rows = accesses.filter(op + " IN ('R', 'W', 'RW')").select(tile, seq, op)
    wrote = F.when(F.col(op).contains("W"), F.col(seq))
    ends = in_buckets(rows, seq, width).groupBy(tile, "_b").agg(F.min(wrote).alias("_f"), F.max(wrote).alias("_l"))
    up, down = (Window.partitionBy(tile).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    beside = ends.select(tile, "_b", F.max("_l").over(up).alias("_p"), F.min("_f").over(down).alias("_n"))
    edges = beside.select(tile, "_b", F.explode(F.array("_p", "_n")).alias(seq), F.lit("W").alias(op)).filter(F.col(seq).isNotNull())
    order = Window.partitionBy(tile, "_b").orderBy(seq)
    # Backwards, so that the frame only grows.
    back = Window.partitionBy(tile, "_b").orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, -1)
    writes, reads = F.col(op).contains("W"), F.col(op).contains("R")
    told = in_buckets(rows, seq, width, edges).select(tile, seq, op, "_g", F.max(wrote).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last"), F.last(wrote, ignorenulls=True).over(back).alias("next"))
    a = told.filter("NOT _g").drop("_g")
    edge = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), tile, F.lit(kind).alias("kind"))
    raw = edge(a.filter(reads & F.col("last").isNotNull()), "last", seq, "RAW")
    waw = edge(a.filter(writes & F.col("last").isNotNull()), "last", seq, "WAW")
    war = edge(a.filter((F.col(op) == "R") & F.col("next").isNotNull()), seq, "next", "WAR")
    return raw.unionByName(waw).unionByName(war)


def disagreement(outgoing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges that only one of two descriptions has."""
    a, b = outgoing.select(*sorted(outgoing.columns)), incoming.select(*sorted(outgoing.columns))
    return a.exceptAll(b).withColumn("only", F.lit("out")).unionByName(b.exceptAll(a).withColumn("only", F.lit("in")))


def reach(edges: DataFrame, start: DataFrame, most: int, cut=None) -> DataFrame:
    """(id, distance) of what can be reached from ``start`` (id) in at most so many steps.

    A step joins what was new in the one before and leaves out what is known; ``cut`` may
    end the lineage of each step.
    """
    seen = new = start.select("id").distinct().withColumn("distance", F.lit(0))
    for k in range(1, most + 1):
        near = new.join(edges.select(F.col("src").alias("id"), "dst"), "id").select(F.col("dst").alias("id")).distinct()
        new = near.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k))
        if cut:
            new = cut(new)
        seen = seen.unionByName(new)
    return seen


def tree(spark: SparkSession, split: str, depth: int) -> DataFrame:
    """(n, l): nodes of a binary tree that grows from (0, 0) while the SQL condition ``split`` on n and l holds."""
    return spark.sql(f"""WITH RECURSIVE t(n, l) AS (SELECT 0, 0L UNION ALL SELECT n + 1, l * 2 + b FROM t, (VALUES (0L), (1L)) AS c(b) WHERE n < {int(depth)} AND ({split})) SELECT n, l FROM t""")


def tree_sums(nodes: DataFrame, value: str, depth: int) -> DataFrame:
    """Each node with the sum of its whole subtree: a node counts for itself and every node above it."""
    up = nodes.select("n", "l", value, F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("up"))
    above = up.select((F.col("n") - F.col("up")).cast("int").alias("n"), F.expr("shiftright(l, up)").alias("l"), value)
    return above.groupBy("n", "l").agg(F.sum(value).alias("total"))


def grow_tree(spark: SparkSession, f: Callable[[str], str], half: float, threshold: float, least: int = 3, depth: int = 31) -> DataFrame:
    """(n, l, s, d): the Haar tree of a function over [-half, half].

    ``f`` gives SQL of the function for SQL of its argument. A node stands for an interval;
    s and d are half the sum and half the difference of the function in the middles of its
    halves. It is split while n < ``least`` or |d| 2**(-n/2) > ``threshold``; a node that isn't
    split is no node of the tree.
    """
    def middle(side: int) -> str:
        return f"(-{half} + {2 * half} * pow(2.0, -(n + 1)) * (0.5 + 2 * l + {side}))"

    left, right = f(middle(0)), f(middle(1))
    split = f"(n < {int(least)} OR abs(0.5 * ({left} - {right})) * pow(2.0, -0.5 * n) > {threshold!r})"
    nodes = tree(spark, split, depth).filter(split)
    return nodes.select("n", "l", F.expr(f"0.5 * ({left} + {right})").alias("s"), F.expr(f"0.5 * ({left} - {right})").alias("d"))


def walk_down(nodes: DataFrame, value: str) -> DataFrame:
    """Each node with what its path from the root adds up to, itself included."""
    path = nodes.select("n", "l", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))).alias("up"))
    path = path.select("n", "l", (F.col("n") - F.col("up")).cast("int").alias("_n"), F.expr("shiftright(l, up)").alias("_l"))
    above = nodes.select(F.col("n").cast("int").alias("_n"), F.col("l").alias("_l"), F.col(value).alias("_v"))
    return path.join(above, ["_n", "_l"]).groupBy("n", "l").agg(F.sum("_v").alias("total"))


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` again and again until ``changed`` (old, new) has no rows: how a computation without a known length ends.

    ``cut`` ends the lineage of each round.
    """
    now = cut(start)
    while True:
        new = cut(step(now))
        if not changed(now, new).limit(1).count():
            return new
        now = new


def labels(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, label): the smallest vertex that each vertex of an edge (a, b) is connected to."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        return now.join(near, "id").select("id", F.least("label", "near").alias("label"))

    return fixpoint(start, step, lambda old, new: old.join(new.withColumnRenamed("label", "now"), "id").filter("label <> now"), cut)


def compose(*pools: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame], DataFrame]:
    """Taskpools one after the other, each over what the one before gave; None is no pool."""
    def run(data: DataFrame) -> DataFrame:
        for pool in pools:
            data = data if pool is None else pool(data)
        return data

    return run


def recursive_tasks(spark: SparkSession, level: int, each: int) -> DataFrame:
    """(level, path, i): tasks that start a pool of ``each`` tasks of the level below, down to level 0. The path has the places of the tasks above."""
    now = spark.range(each).select(F.lit(level).alias("level"), F.array().cast("array<long>").alias("path"), F.col("id").alias("i"))
    out = now
    for below in range(level - 1, -1, -1):
        inner = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))).alias("i")
        now = now.select(F.lit(below).alias("level"), F.concat("path", F.array("i")).alias("path"), inner)
        out = out.unionByName(now)
    return out


def inserted(generators: DataFrame, total: str, increment: str) -> DataFrame:
    """Tasks that generator tasks insert: ``seq`` from 0, and in which of the generator's runs.

    A generator that has inserted ``increment`` + 1 tasks in a run is put off to the next.
    """
    seq = F.explode(F.expr(f"CASE WHEN {total} > 0 THEN sequence(0L, cast({total} as long) - 1) ELSE array() END"))
    return generators.withColumn("seq", seq).withColumn("run", F.expr(f"seq div ({increment} + 1)"))


#: What a flag of an access means for dependencies: R, W or RW, or nothing ('-').
ACCESS = {"INPUT": "R", "OUTPUT": "W", "INOUT": "RW", "SCRATCH": "-", "VALUE": "-", "REF": "-"}


def access_of(flags: Column) -> Column:
    """R, W, RW or '-' of flags 'INOUT|AFFINITY'; DONT_TRACK makes an access no dependency; placement flags don't matter."""
    has = lambda name: F.array_contains(F.split(flags, r"\|"), name)
    told = F.coalesce(*(F.when(has(name), F.lit(op)) for name, op in ACCESS.items()), F.lit("-"))
    return F.when(has("DONT_TRACK"), "-").otherwise(told)


def flushed(accesses: DataFrame, owners: DataFrame, tile: str = "tile", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """What a flush writes back to each owner: (tile, owner, value, version), the value of the last write, for tiles that were written."""
    writes = accesses.filter(F.col(op).contains("W"))
    last = writes.groupBy(tile).agg(F.max_by(value, seq).alias("value"), F.count(F.lit(1)).alias("version"), F.max_by("rank", seq).alias("sender"))
    return last.join(owners, tile).select(tile, "owner", "sender", "value", "version")


def user_space(spark: SparkSession, ranges: dict[str, tuple], key: Callable[[dict[str, Column]], Column], startup: Callable[[dict[str, Column]], Column], waits: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """A task space whose key, starting tasks and number of inputs are the caller's functions of its places."""
    tasks = task_space(spark, **ranges)
    places = {c: F.col(c) for c in tasks.columns}
    return tasks.select("*", key(places).alias("key"), startup(places).alias("starts"), waits(places).alias("waits"))


def dump(tasks: DataFrame, edges: DataFrame, name: str, places: list[str], to: list[str]) -> DataFrame:
    """Lines of the graph of a task space: its tasks, and its edges as ``guarded`` gives them."""
    label = lambda columns: F.concat(F.lit(f"{name}("), F.concat_ws(", ", *(F.col(c).cast("string") for c in columns)), F.lit(")"))
    nodes = tasks.select(F.format_string('"%s";', label(places)).alias("line"))
    return nodes.unionByName(edges.select(F.format_string('"%s" -> "%s";', label(places), label(to)).alias("line")))


def chase(spark: SparkSession, view: str, start: int, steps: int) -> DataFrame:
    """(step, id): a walk along ``next`` of a view of (id, next)."""
    return spark.sql(f"WITH RECURSIVE w(step, id) AS (SELECT 0L, {int(start)}L UNION ALL SELECT step + 1, v.next FROM w JOIN {view} v ON v.id = w.id WHERE step < {int(steps)}) SELECT step, id FROM w")


def topological_orders(tasks: list, edges: list[tuple]) -> Iterator[list]:
    """All orders of a small graph, on the driver; their number is exponential by nature."""
    before = {t: {a for a, b in edges if b == t} for t in tasks}

    def go(done: list) -> Iterator[list]:
        if len(done) == len(tasks):
            yield list(done)
        for t in tasks:
            if t not in done and before[t] <= set(done):
                yield from go([*done, t])

    return go([])
