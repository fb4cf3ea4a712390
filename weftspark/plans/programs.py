"""Small programs of task graphs and traces as queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.functions import placement as P
from weftspark.functions import scalars
from weftspark.functions.placement import Grid
from weftspark.operators import graph as G
from weftspark.operators import trace as T
from weftspark.plans.tiles import TILES, tiles
from weftspark.plans.trace import DESCRIBE, EV, IV, events, intervals

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("""SELECT i, -1 AS j, i + 1 AS ti, -1 AS tj, 0 AS flow FROM generate_series(0, 18) x(i) UNION ALL SELECT i, -1, i, 0, 1 FROM generate_series(0, 19) x(i)
UNION ALL SELECT i, j, i, j + 1, 2 FROM generate_series(0, 19) x(i), generate_series(0, 8) y(j)""")
def program_multichain(s, d):
    """A horizontal chain whose every link starts a vertical one."""
    t = G.task_space(s, i=(0, 19), j=(-1, 9))
    return G.guarded(t, ("j = -1 AND i < 19", {"ti": "i + 1", "tj": "-1"}), ("j = -1", {"ti": "i", "tj": "0"}), ("j BETWEEN 0 AND 8", {"ti": "i", "tj": "j + 1"}))


@query("SELECT k, c, t, c * 8 AS displacement FROM generate_series(0, 15) x(k), generate_series(0, 3) y(c), generate_series(0, 15) z(t) WHERE t >= k AND (t - k) % (c + 1) = 0")
def program_complex_deps(s, d):
    """One producer feeds four classes by ranges of growing step, each with a part of its datum."""
    t = G.task_space(s, k=(0, 15), c=(0, 3))
    return G.fan_out(t, "t", "k", "15", "c + 1").select("k", "c", "t", (F.col("c") * 8).alias("displacement"))


@query("SELECT k AS hop, k % 4 AS rank, CASE WHEN k % 2 = 0 THEN 7 ELSE 11 END AS a, CASE WHEN k % 2 = 0 THEN 11 ELSE 7 END AS b FROM generate_series(0, 63) x(k)")
def program_swapped_flows(s, d):
    """Two values sent round the ranks that change places at each hop."""
    even = F.col("id") % 2 == 0
    return s.range(64).select(F.col("id").alias("hop"), (F.col("id") % 4).alias("rank"), F.when(even, 7).otherwise(11).alias("a"), F.when(even, 11).otherwise(7).alias("b"))


@query(f"WITH {TILES} SELECT m // 4 % 2 * 3 + n // 2 % 3 AS cyclic, m % 2 * 3 + n % 3 AS plain, count(*) AS tiles FROM t GROUP BY ALL")
def program_k_cyclic(s, d):
    """How tiles of a plain distribution lie in a k-cyclic one."""
    m, n, g = F.col("m"), F.col("n"), Grid(2, 3)
    return tiles(s).groupBy(P.k_cyclic(m, n, g, 4, 2).alias("cyclic"), P.block_cyclic(m, n, g).alias("plain")).agg(F.count(F.lit(1)).alias("tiles"))


@query("SELECT 0 AS src, r AS dst, 0 AS tile, 'RAW' AS kind FROM generate_series(1, 20) x(r) UNION ALL SELECT r, 21, 0, 'WAR' FROM generate_series(1, 20) x(r) UNION ALL SELECT 0, 21, 0, 'WAW'")
def program_write_after_read(s, d):
    """A writer, many readers, a writer."""
    op = F.when(F.col("id").isin(0, 21), "W").otherwise("R")
    return G.infer_dependencies(s.range(22).select(F.lit(0).alias("tile"), F.col("id").alias("seq"), op.alias("op")))


@query("SELECT g, count(*) AS made, CAST(sum(2 * (k + g)) AS BIGINT) AS total FROM generate_series(0, 9) x(g), generate_series(0, 9) y(k) WHERE k <= g GROUP BY g")
def program_new_tiles(s, d):
    """Tasks that make tiles: set, doubled, and added up for each maker."""
    t = G.task_space(s, g=(0, 9), k=(0, "g"))
    return t.groupBy("g").agg(F.count(F.lit(1)).alias("made"), F.sum(2 * (F.col("k") + F.col("g"))).alias("total"))


@query("SELECT p_partkey AS id, CAST(trunc((p_partkey - 50)::DOUBLE / p_size) AS BIGINT) AS quotient, (p_partkey - 50) % p_size AS remainder, p_partkey << 2 AS up, p_partkey >> 1 AS down, xor(p_partkey, p_size) AS mixed, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS large FROM part")
def function_integers(s, d):
    """The integer operators of task expressions."""
    p, n = F.col("p_partkey"), F.col("p_size").cast("long")
    return s.read.parquet(f"{d}/part.parquet").select(p.alias("id"), scalars.divide(p - 50, n).alias("quotient"), ((p - 50) % n).alias("remainder"), F.shiftleft(p, 2).alias("up"), F.shiftright(p, 1).alias("down"), p.bitwiseXOR(n).alias("mixed"), F.when(n > 25, 1).otherwise(0).alias("large"))


@query("SELECT p_partkey AS id, concat_ws(' ', CASE WHEN p_size <> 1 THEN 'p_size=' || p_size END, 'p_brand=' || p_brand) AS description FROM part")
def function_describe_run(s, d):
    """key=value parts of what is known of a run."""
    p = s.read.parquet(f"{d}/part.parquet").withColumn("p_size", F.when(F.col("p_size") != 1, F.col("p_size")))
    return p.select(F.col("p_partkey").alias("id"), scalars.describe_run(["p_size", "p_brand"]).alias("description"))


@query(f"WITH {EV} SELECT type, {DESCRIBE} FROM ev WHERE ptr > 40 GROUP BY type")
def trace_counter_stats(s, d):
    """A description of a counter where another one is positive."""
    return T.describe(events(s, d).filter("ptr > 40"), "type", "size")


@query(f'WITH {IV}, x AS (SELECT id, stream, "begin" AS time, ptr AS counter FROM iv UNION ALL SELECT id, stream, "end", ptr + size FROM iv) SELECT stream, max(counter) AS most, CAST(floor(log10(greatest(max(counter), 1)::DOUBLE) / 3) AS INTEGER) AS thousands, count(*) AS points FROM x GROUP BY stream')
def trace_counter_points(s, d):
    """Counter values at both ends of intervals: the largest, and its power of a thousand."""
    i = intervals(s, d)
    x = i.selectExpr("id", "stream", "stack(2, begin, ptr, end, ptr + size) AS (time, counter)")
    most = F.max("counter")
    return x.groupBy("stream").agg(most.alias("most"), F.floor(F.log10(F.greatest(most, F.lit(1)).cast("double")) / 3).cast("int").alias("thousands"), F.count(F.lit(1)).alias("points"))
