"""Task-graph queries, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftspark.operators import graph as G
from weftspark.plans.trace import EV, events
from weftspark.sources.shared import written

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT i, j, k, (i + j) % 4 AS owner FROM generate_series(0, 9) x(i), generate_series(0, 20, 2) y(j), generate_series(0, 30) z(k) WHERE k <= i")
def task_space(s, d):
    return G.task_space(s, i=(0, 9), j=(0, 20, 2), k=(0, "i")).select("i", "j", "k", ((F.col("i") + F.col("j")) % 4).alias("owner"))


@query("SELECT i, j, 0 AS flow, i + 1 AS ti, j AS tj FROM generate_series(0, 19) x(i), generate_series(0, 9) y(j) WHERE j = 0 AND i < 19 UNION ALL SELECT i, j, 1, i, j + 1 FROM generate_series(0, 19) x(i), generate_series(0, 9) y(j) WHERE j < 9")
def task_guarded(s, d):
    return G.guarded(G.task_space(s, i=(0, 19), j=(0, 9)), ("j = 0 AND i < 19", {"ti": "i + 1", "tj": "j"}), ("j < 9", {"ti": "i", "tj": "j + 1"}))


@query("SELECT k, t FROM generate_series(0, 49) x(k), generate_series(0, 98) y(t) WHERE t BETWEEN k AND 2 * k AND (t - k) % 3 = 0")
def task_fan_out(s, d):
    return G.fan_out(G.task_space(s, k=(0, 49)), "t", "k", "2 * k", "3")


@query("SELECT t, count(*) AS waits FROM generate_series(0, 49) x(k), generate_series(0, 98) y(t) WHERE t BETWEEN k AND 2 * k GROUP BY t")
def task_gather(s, d):
    return G.gathered(G.fan_out(G.task_space(s, k=(0, 49)), "t", "k", "2 * k"), "t")


@query("SELECT k, CASE WHEN k * 7 % 5 < 2 THEN 'a' ELSE 'b' END AS branch, CASE WHEN k * 7 % 5 < 2 THEN k + 1 ELSE k - 1 END AS target FROM generate_series(0, 99) x(k)")
def task_choice(s, d):
    c = F.col("k") * 7 % 5 < 2
    return G.task_space(s, k=(0, 99)).select("k", F.when(c, "a").otherwise("b").alias("branch"), F.when(c, F.col("k") + 1).otherwise(F.col("k") - 1).alias("target"))


@query("SELECT k, a, b FROM generate_series(0, 19) x(k), generate_series(0, 19) y(a), generate_series(0, 40) z(b) WHERE a <= k AND b BETWEEN a AND a + k AND (b - a) % 2 = 0")
def task_local_indices(s, d):
    return G.fan_out(G.fan_out(G.task_space(s, k=(0, 19)), "a", "0L", "k"), "b", "a", "a + k", "2")


@query("SELECT i, j, k, (i * 16 + j * 4 + k) AS priority FROM generate_series(0, 7) x(i), generate_series(0, 7) y(j), generate_series(0, 3) z(k)")
def task_startup(s, d):
    return G.task_space(s, i=(0, 7), j=(0, 7), k=(0, 3)).select("*", F.expr("i * 16 + j * 4 + k").alias("priority"))


@query("SELECT k, n, CASE WHEN n = k THEN 'diagonal' ELSE 'column' END AS kind, CASE WHEN n = k THEN 3 ELSE 2 END AS size FROM generate_series(0, 11) x(k), generate_series(0, 11) y(n) WHERE n >= k AND (n = k OR (n - k) % 2 = 0)")
def task_cholesky_shape(s, d):
    e = G.fan_out(G.task_space(s, k=(0, 11)), "n", "k", "11", "2")
    return e.select("k", "n", F.when(F.col("n") == F.col("k"), "diagonal").otherwise("column").alias("kind"), F.when(F.col("n") == F.col("k"), 3).otherwise(2).alias("size"))


_ACCESS = "a AS (SELECT ptr AS tile, id AS seq, CASE type WHEN 'view' THEN 'R' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'RW' ELSE '-' END AS op FROM ev)"


def _accesses(s, d):
    op = F.when(F.col("type").isin("view", "click"), "R").when(F.col("type") == "purchase", "W").when(F.col("type") == "signup", "RW").otherwise("-")
    return events(s, d).select(F.col("ptr").alias("tile"), F.col("id").alias("seq"), op.alias("op"))


@query(f"""WITH {EV}, {_ACCESS}, t AS (SELECT *, max(CASE WHEN op IN ('W', 'RW') THEN seq END) OVER (PARTITION BY tile ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, min(CASE WHEN op IN ('W', 'RW') THEN seq END) OVER (PARTITION BY tile ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM a WHERE op <> '-')
SELECT last AS src, seq AS dst, tile, 'RAW' AS kind FROM t WHERE op IN ('R', 'RW') AND last IS NOT NULL UNION ALL SELECT last, seq, tile, 'WAW' FROM t WHERE op IN ('W', 'RW') AND last IS NOT NULL UNION ALL SELECT seq, next, tile, 'WAR' FROM t WHERE op = 'R' AND next IS NOT NULL""")
def dtd_edges(s, d):
    return G.infer_dependencies(_accesses(s, d))


@query(f"WITH {EV}, {_ACCESS} SELECT tile, max(CASE WHEN op IN ('W', 'RW') THEN seq END) AS writer, count(*) FILTER (WHERE op IN ('W', 'RW')) AS version FROM a GROUP BY tile")
def dtd_flush(s, d):
    w = F.col("op").isin("W", "RW")
    return _accesses(s, d).groupBy("tile").agg(F.max(F.when(w, F.col("seq"))).alias("writer"), F.count(F.when(w, 1)).alias("version"))


@query("SELECT i AS a, i + 1 AS b, 'out' AS \"only\" FROM generate_series(0, 98) x(i) WHERE i % 10 = 9 UNION ALL SELECT i, i + 2, 'in' FROM generate_series(0, 97) x(i) WHERE i % 25 = 0")
def graph_check_iterators(s, d):
    t = s.range(99).withColumnRenamed("id", "a")
    out = t.select("a", (F.col("a") + 1).alias("b"))
    back = out.filter("a % 10 <> 9").unionByName(t.filter("a % 25 = 0 AND a < 98").select("a", (F.col("a") + 2).alias("b")))
    return G.disagreement(out, back)


@query("""WITH RECURSIVE e AS (SELECT k AS src, (k * 3 + b) % 200 AS dst FROM generate_series(0, 199) x(k), generate_series(0, 1) y(b)),
r(id, distance) AS (SELECT 5::BIGINT, 0 UNION SELECT e.dst, r.distance + 1 FROM r JOIN e ON e.src = r.id WHERE r.distance < 4) SELECT id, min(distance) AS distance FROM r GROUP BY id""")
def graph_reach(s, d):
    e = s.range(200).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 3) % 200, (F.col("id") * 3 + 1) % 200)).alias("dst"))
    return G.reach(e, s.range(5, 6), 4)


@query("WITH RECURSIVE t(n, l) AS (SELECT 0, 0::BIGINT UNION ALL SELECT n + 1, l * 2 + b FROM t, (VALUES (0), (1)) c(b) WHERE n < 9 AND (n < 3 OR (l * 7 + n) % 3 <> 0)) SELECT n, count(*) AS nodes, CAST(bit_xor(l * 31 + n) AS BIGINT) AS checksum FROM t GROUP BY n")
def haar_tree_levels(s, d):
    t = G.tree(s, "n < 3 OR (l * 7 + n) % 3 <> 0", 9)
    return t.groupBy("n").agg(F.count(F.lit(1)).alias("nodes"), F.bit_xor(F.col("l") * 31 + F.col("n")).alias("checksum"))


@query("""WITH RECURSIVE t(n, l) AS (SELECT 0, 0::BIGINT UNION ALL SELECT n + 1, l * 2 + b FROM t, (VALUES (0), (1)) c(b) WHERE n < 6)
SELECT a.n, a.l, CAST(sum(b.l + b.n) AS BIGINT) AS total FROM t a JOIN t b ON b.n >= a.n AND (b.l >> (b.n - a.n)) = a.l GROUP BY a.n, a.l""")
def tree_walk(s, d):
    return G.tree_sums(G.tree(s, "true", 6).withColumn("v", F.col("l") + F.col("n")), "v", 6)


@query("WITH RECURSIVE w(step, id) AS (SELECT 0::BIGINT, 3::BIGINT UNION ALL SELECT step + 1, (id * 7 + 1) % 101 FROM w WHERE step < 50) SELECT step, id, 3 + step AS value FROM w")
def pointer_chase(s, d):
    view = f"chain_{uuid.uuid4().hex}"
    s.range(101).select("id", ((F.col("id") * 7 + 1) % 101).alias("next")).createOrReplaceTempView(view)
    return G.chase(s, view, 3, 50).withColumn("value", F.col("step") + 3)


@query("SELECT o.o_orderkey AS task, CAST(count(*) AS BIGINT) AS successors, min(l.l_linenumber) AS first FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_suppkey % 4 = o.o_custkey % 4 GROUP BY o.o_orderkey")
def task_successors(s, d):
    o, l = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    near = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).filter("l_suppkey % 4 = o_custkey % 4")
    return near.groupBy(F.col("o_orderkey").alias("task")).agg(F.count(F.lit(1)).alias("successors"), F.min("l_linenumber").alias("first"))


@query("SELECT level, CAST(1 << level AS BIGINT) AS tasks FROM generate_series(0, 10) x(level)")
def task_tree_counts(s, d):
    t = G.fan_out(G.task_space(s, level=(0, 10)), "k", "0L", "shiftleft(1L, cast(level as int)) - 1")
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("tasks"))


_SPLIT = "(n < 3 OR abs(0.5 * (exp(-(-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 0)) * (-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 0))) - exp(-(-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 1)) * (-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 1))))) * pow(2.0, -0.5 * n) > 0.001)"
_HALF = [f"exp(-{x} * {x})" for x in ("(-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 0))", "(-10.0 + 20.0 * pow(2.0, -(n + 1)) * (0.5 + 2 * l + 1))")]


@query(f"WITH RECURSIVE t(n, l) AS (SELECT 0, 0::BIGINT UNION ALL SELECT n + 1, l * 2 + b FROM t, (VALUES (0), (1)) c(b) WHERE n < 31 AND {_SPLIT}) SELECT n, l, round(0.5 * ({_HALF[0]} + {_HALF[1]}), 9) AS s, round(0.5 * ({_HALF[0]} - {_HALF[1]}), 9) AS d FROM t WHERE {_SPLIT}")
def haar_tree_project(s, d):
    """The tree of exp(-x * x) over [-10, 10], split while its error is above 0.001."""
    t = G.grow_tree(s, lambda x: f"exp(-{x} * {x})", 10.0, 0.001)
    return t.select("n", "l", F.round("s", 9).alias("s"), F.round("d", 9).alias("d"))


@query("""WITH RECURSIVE t(n, l) AS (SELECT 0, 0::BIGINT UNION ALL SELECT n + 1, l * 2 + b FROM t, (VALUES (0), (1)) c(b) WHERE n < 6)
SELECT b.n, b.l, CAST(sum(a.l + a.n) AS BIGINT) AS total FROM t a JOIN t b ON b.n >= a.n AND (b.l >> (b.n - a.n)) = a.l GROUP BY b.n, b.l""")
def tree_walk_down(s, d):
    return G.walk_down(G.tree(s, "true", 6).withColumn("v", F.col("l") + F.col("n")), "v")


@query("SELECT 2 AS level, i, ''::VARCHAR AS path FROM generate_series(0, 2) x(i) UNION ALL SELECT 1, i, a::VARCHAR FROM generate_series(0, 2) x(i), generate_series(0, 2) y(a) UNION ALL SELECT 0, i, a || ',' || b FROM generate_series(0, 2) x(i), generate_series(0, 2) y(a), generate_series(0, 2) z(b)")
def task_recursive(s, d):
    """Tasks that start pools of tasks, three levels deep."""
    return G.recursive_tasks(s, 2, 3).select("level", "i", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query("SELECT o_custkey % 10 AS k, CAST(sum(o_orderkey * 2 + 1) AS BIGINT) AS total FROM orders GROUP BY 1 HAVING sum(o_orderkey * 2 + 1) % 2 = 0")
def task_compose(s, d):
    """Three pools in sequence: a map, a reduction, a choice."""
    doubled = lambda x: x.select((F.col("o_custkey") % 10).alias("k"), (F.col("o_orderkey") * 2 + 1).alias("v"))
    added = lambda x: x.groupBy("k").agg(F.sum("v").alias("total"))
    return G.compose(doubled, None, added, lambda x: x.filter("total % 2 = 0"))(s.read.parquet(f"{d}/orders.parquet"))


@query("SELECT g, i AS seq, i // 6 AS run FROM generate_series(0, 4) y(g), generate_series(0, 19) x(i)")
def task_inserting(s, d):
    """Five generators that insert twenty tasks each and are put off after six."""
    return G.inserted(G.task_space(s, g=(0, 4)), "20", "5").select("g", "seq", "run")


@query("SELECT m AS rank, CAST(1 + 100 AS BIGINT) AS tasks FROM generate_series(0, 7) x(m)")
def task_hierarchy(s, d):
    """A generator on each rank that makes a pool of a hundred tasks: all that ran there."""
    made = G.inserted(G.task_space(s, rank=(0, 7)), "100", "100").select("rank")
    return made.unionByName(G.task_space(s, rank=(0, 7))).groupBy("rank").agg(F.count(F.lit(1)).alias("tasks"))


_FLAGS = "['INPUT|AFFINITY', 'OUTPUT', 'INOUT|PUSHOUT', 'INOUT|DONT_TRACK', 'SCRATCH', 'VALUE|AFFINITY', 'INPUT|PULLIN']"


@query(f"""WITH a AS (SELECT l_suppkey % 20 AS tile, l_orderkey * 10 + min(l_linenumber) AS seq, {_FLAGS}[CAST(l_orderkey % 7 AS INTEGER) + 1] AS flags FROM lineitem GROUP BY l_suppkey % 20, l_orderkey),
t AS (SELECT tile, seq, CASE WHEN flags LIKE '%DONT_TRACK%' THEN '-' WHEN flags LIKE 'INPUT%' THEN 'R' WHEN flags LIKE 'OUTPUT%' THEN 'W' WHEN flags LIKE 'INOUT%' THEN 'RW' ELSE '-' END AS op FROM a),
x AS (SELECT *, max(CASE WHEN op IN ('W', 'RW') THEN seq END) OVER (PARTITION BY tile ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, min(CASE WHEN op IN ('W', 'RW') THEN seq END) OVER (PARTITION BY tile ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM t WHERE op <> '-')
SELECT last AS src, seq AS dst, tile, 'RAW' AS kind FROM x WHERE op IN ('R', 'RW') AND last IS NOT NULL UNION ALL SELECT last, seq, tile, 'WAW' FROM x WHERE op IN ('W', 'RW') AND last IS NOT NULL UNION ALL SELECT seq, next, tile, 'WAR' FROM x WHERE op = 'R' AND next IS NOT NULL""")
def dtd_flags(s, d):
    """Dependencies by access flags; accesses that aren't tracked make none."""
    names = F.array(*(F.lit(x) for x in ("INPUT|AFFINITY", "OUTPUT", "INOUT|PUSHOUT", "INOUT|DONT_TRACK", "SCRATCH", "VALUE|AFFINITY", "INPUT|PULLIN")))
    a = s.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_suppkey") % 20).alias("tile"), "l_orderkey").agg(F.min("l_linenumber").alias("line"))
    a = a.select("tile", (F.col("l_orderkey") * 10 + F.col("line")).alias("seq"), G.access_of(names[(F.col("l_orderkey") % 7).cast("int")]).alias("op"))
    return G.infer_dependencies(a)


@query("""WITH a AS (SELECT l_partkey AS tile, l_orderkey * 10 + l_linenumber AS seq, l_suppkey % 4 AS rank, max(CAST(round(l_quantity) AS BIGINT)) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL), w AS (SELECT tile, seq, max(rank) AS rank, max_by(value, rank) AS value FROM a GROUP BY tile, seq)
SELECT tile, tile % 4 AS owner, max_by(rank, seq) AS sender, max_by(value, seq) AS value, count(*) AS version FROM w GROUP BY tile""")
def dtd_flush_values(s, d):
    """What each part's last writer sends back to the tile's owner."""
    l = s.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag <> 'N'")  # noqa: E741
    rows = l.groupBy(F.col("l_partkey").alias("tile"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_suppkey") % 4).alias("rank")).agg(F.max(F.round("l_quantity").cast("long")).alias("value"))
    one = rows.groupBy("tile", "seq").agg(F.max("rank").alias("rank"), F.max_by("value", "rank").alias("value")).withColumn("op", F.lit("W"))
    return G.flushed(one, one.select("tile").distinct().withColumn("owner", F.col("tile") % 4))


@query("SELECT 'agree' AS told, CAST(99 + 20 * 9 AS BIGINT) AS edges")
def graph_ptg_as_dtd(s, d):
    """A chain and twenty shorter ones, by guarded edges and by the order of their accesses: what only one of the two says, and what both do."""
    t = G.task_space(s, c=(0, 20), k=(0, "CASE WHEN c = 0 THEN 99 ELSE 9 END"))
    seq = F.col("c") * 1000 + F.col("k")
    told = G.guarded(t, ("k < CASE WHEN c = 0 THEN 99 ELSE 9 END", {"tc": "c", "tk": "k + 1"})).select(seq.alias("src"), (F.col("tc") * 1000 + F.col("tk")).alias("dst"))
    seen = G.infer_dependencies(t.select(F.col("c").alias("tile"), seq.alias("seq"), F.lit("RW").alias("op"))).filter("kind = 'RAW'").select("src", "dst")
    apart = G.disagreement(told, seen).select(F.col("only").alias("told"))
    both = told.intersect(seen).select(F.lit("agree").alias("told"))
    return apart.unionByName(both).groupBy("told").agg(F.count(F.lit(1)).alias("edges"))


@query("""SELECT '"Task(' || i || ', ' || j || ')";' AS line FROM generate_series(0, 9) x(i), generate_series(0, 4) y(j)
UNION ALL SELECT '"Task(' || i || ', ' || j || ')" -> "Task(' || i || ', ' || (j + 1) || ')";' FROM generate_series(0, 9) x(i), generate_series(0, 3) y(j)""")
def graph_dump(s, d):
    t = G.task_space(s, i=(0, 9), j=(0, 4))
    return G.dump(t, G.guarded(t, ("j < 4", {"ti": "i", "tj": "j + 1"})), "Task", ["i", "j"], ["ti", "tj"])


@query("SELECT m, n, m * 1000 + n AS key, m = 0 AS starts, CASE WHEN m > 0 THEN 1 ELSE 0 END + CASE WHEN n > 0 THEN 1 ELSE 0 END AS waits FROM generate_series(0, 19, 3) x(m), generate_series(0, 14, 2) y(n)")
def task_user_functions(s, d):
    """A space with a computed step whose key, startup and counts of inputs are given functions."""
    step = (lambda: 3)()
    return G.user_space(s, {"m": (0, 19, step), "n": (0, 14, 2)}, lambda p: p["m"] * 1000 + p["n"], lambda p: p["m"] == 0, lambda p: (p["m"] > 0).cast("int") + (p["n"] > 0).cast("int"))


@query("SELECT k, p, k * 4 + p AS pos, k * 7 % 2 + 1 AS decision, CASE WHEN k * 7 % 2 = 0 THEN 'a' ELSE 'b' END AS branch FROM generate_series(0, 29) x(k), generate_series(0, 3) y(p)")
def task_shared_choice(s, d):
    """Each choice made on one rank, shared with all, and the branch that follows."""
    made = G.task_space(s, k=(0, 29)).withColumn("decision", F.col("k") * 7 % 2 + 1)
    told = G.fan_out(made, "p", "0L", "3L")
    return told.select("k", "p", (F.col("k") * 4 + F.col("p")).alias("pos"), "decision", F.when(F.col("decision") == 1, "a").otherwise("b").alias("branch"))


@query("SELECT kind, i, CAST(1 << (i + 1) AS BIGINT) AS tasks FROM (VALUES ('out'), ('in')) v(kind), generate_series(0, 7) x(i) UNION ALL SELECT kind, 0, 1 FROM (VALUES ('start'), ('end')) v(kind)")
def task_tree_fan(s, d):
    """A binary tree of tasks that fans out, and one that fans in."""
    level = G.fan_out(G.task_space(s, i=(0, 7)), "j", "0L", "shiftleft(1L, cast(i + 1 as int)) - 1")
    ends = s.range(1).select(F.explode(F.array(F.lit("start"), F.lit("end"))).alias("kind"), F.lit(0).cast("long").alias("i"))
    both = level.select(F.explode(F.array(F.lit("out"), F.lit("in"))).alias("kind"), "i").unionByName(ends)
    return both.groupBy("kind", "i").agg(F.count(F.lit(1)).alias("tasks"))


@query("SELECT o_orderkey AS task, o_custkey % 4 AS intended, CASE WHEN o_custkey % 4 < 3 THEN o_custkey % 4 ELSE 0 END AS executed FROM orders")
def task_placement(s, d):
    """Tasks run on the rank they ask for; where there is no such rank (there are three), on the first."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 4).alias("intended"))
    return o.withColumn("executed", F.when(F.col("intended") < 3, F.col("intended")).otherwise(0))


@query("SELECT 1000 + n_nationkey AS id, n_regionkey AS label FROM nation UNION ALL SELECT DISTINCT n_regionkey::BIGINT, n_regionkey FROM nation UNION ALL SELECT DISTINCT 1000000 + c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_components(s, d):
    """Customers, nations and regions as one graph: rounds until nothing changes."""
    n, c = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/customer.parquet")
    up = n.select((F.col("n_nationkey") + 1000).cast("long").alias("a"), F.col("n_regionkey").cast("long").alias("b"))
    down = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select((F.col("c_custkey") + 1000000).alias("a"), (F.col("c_nationkey") + 1000).cast("long").alias("b"))
    return G.labels(up.unionByName(down), written)


@query("""WITH n0 AS (SELECT o_orderkey AS id, 0 AS distance FROM orders WHERE o_custkey = 7), n1 AS (SELECT DISTINCT 10000000 + l_partkey AS id, 1 AS distance FROM lineitem JOIN n0 ON l_orderkey = n0.id),
n2 AS (SELECT DISTINCT l_orderkey AS id, 2 AS distance FROM lineitem JOIN n1 ON 10000000 + l_partkey = n1.id WHERE l_orderkey NOT IN (SELECT id FROM n0)) SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2""")
def graph_reach_orders(s, d):
    """Orders that share a part with a customer's orders, by a walk over all orders and parts."""
    l = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") + 10000000).alias("p")).distinct()  # noqa: E741
    edges = l.select(F.col("o").alias("src"), F.col("p").alias("dst")).unionByName(l.select(F.col("p").alias("src"), F.col("o").alias("dst")))
    start = s.read.parquet(f"{d}/orders.parquet").filter("o_custkey = 7").select(F.col("o_orderkey").alias("id"))
    return G.reach(edges, start, 2)
