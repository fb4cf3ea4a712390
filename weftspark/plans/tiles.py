"""Matrix queries: embeddings as a matrix of whole millionths, and the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import placement as P
from weftspark.functions.placement import Grid
from weftspark.operators import tiles as M
from weftspark.operators import udf as U

CELLS = """c AS (SELECT vec_id AS i, unnest(generate_series(0, len(embedding) - 1)) AS j, unnest(embedding) AS x FROM embeddings),
a AS (SELECT i, j, CAST(round(x::DOUBLE * 1000000) AS BIGINT) AS v FROM c)"""
TILES = "t AS (SELECT m, n FROM generate_series(0, 39) x(m), generate_series(0, 39) y(n))"


def cells(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.round(F.col("x").cast("double") * 1000000).cast("long").alias("v"))


def tiles(s: SparkSession) -> DataFrame:
    return s.range(1600).select(F.expr("id div 40").alias("m"), (F.col("id") % 40).alias("n"))


QUERIES, SQL = {}, {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


@query(f"WITH {CELLS} SELECT i, j, v * 2 + 1 AS v FROM a")
def tile_map(s, d):
    return M.map_cells(cells(s, d), lambda v: v * 2 + 1)


@query(f"WITH {CELLS} SELECT x.i, x.j, x.v - y.v AS v FROM a x JOIN a y ON x.i + 1 = y.i AND x.j = y.j")
def tile_map_binary(s, d):
    c = cells(s, d)
    return M.map_cells(c, None, c.select((F.col("i") - 1).alias("i"), "j", "v"), lambda x, y: x - y)


for _kind, _test in (("upper", "j >= i"), ("lower", "i >= j"), ("full", "true")):
    query(f"WITH {CELLS} SELECT i, j, CASE WHEN {_test} THEN -v ELSE v END AS v FROM a", f"tile_apply_{_kind}")(lambda s, d, k=_kind: M.apply_region(cells(s, d), k, lambda v: -v))


@query(f"WITH {CELLS} SELECT i, j, CASE WHEN i > j THEN 0 ELSE v END AS v FROM a")
def tile_reshape_zero(s, d):
    return M.apply_region(cells(s, d), M.LOWER, lambda v: F.lit(0), diagonal=False)


@query(f"WITH {CELLS} SELECT i, j, v, i // 8 AS m, j // 8 AS n FROM a WHERE i // 8 > j // 8")
def tile_triangle(s, d):
    return M.triangle_tiles(M.with_tiles(cells(s, d), 8, 8))


@query(f"WITH {CELLS} SELECT i - 10 AS i, j - 5 AS j, v FROM a WHERE i BETWEEN 10 AND 109 AND j BETWEEN 5 AND 44")
def tile_submatrix(s, d):
    return M.submatrix(cells(s, d), 10, 5, 100, 40)


@query(f"WITH {CELLS} SELECT i - 16 AS i, j - 32 AS j, v, (i - 16) // 4 AS m, (j - 32) // 4 AS n FROM a WHERE i BETWEEN 16 AND 31 AND j BETWEEN 32 AND 47")
def tile_subtile(s, d):
    return M.subtile(cells(s, d), 1, 2, 16, 16, 4, 4)


@query(f"WITH {CELLS} SELECT i, j, i - j + 2 AS r, v FROM a WHERE abs(i - j) < 3")
def tile_band(s, d):
    return cells(s, d).filter(P.in_band(F.col("i"), F.col("j"), 3)).select("i", "j", (F.col("i") - F.col("j") + 2).alias("r"), "v")


@query(f"""WITH {CELLS}, g AS (SELECT r, c FROM generate_series(0, 8) x(r), generate_series(0, 79) y(c)), k AS (SELECT i - j AS r, j + j // 8 * 2 AS c, v FROM a WHERE i - j BETWEEN 0 AND 8 AND j < 64)
SELECT g.r, g.c, coalesce(k.v, 0) AS v FROM g LEFT JOIN k ON g.r = k.r AND g.c = k.c""")
def tile_band_rect(s, d):
    return M.band_to_rectangle(cells(s, d), 8, 64, 8)


for _by, _key in (("all", ""), ("row", "i // 16 AS m, "), ("col", "j // 16 AS n, ")):
    query(f"WITH {CELLS} SELECT {_key}i % 16 AS a, j % 16 AS b, CAST(sum(v) AS BIGINT) AS v FROM a GROUP BY ALL", f"tile_reduce_{_by}")(lambda s, d, k=_by: M.reduce_tiles(cells(s, d), 16, 16, F.sum, k))


@query(f"WITH {CELLS} SELECT i % 100 AS a, j AS b, CAST(sum(v) AS BIGINT) AS v FROM a GROUP BY ALL")
def tile_reduce_general(s, d):
    """Any number of tiles: the sum doesn't depend on the shape of the tree."""
    return M.reduce_tiles(cells(s, d), 100, 64, F.sum)


@query(f"WITH {CELLS} SELECT i, j, v, CAST(sum(v) OVER (PARTITION BY j) AS BIGINT) AS total FROM a")
def tile_allreduce(s, d):
    return M.all_reduce(cells(s, d), F.sum).select("i", "j", "v", "total")


@query(f"WITH {CELLS} SELECT x.i, y.j, CAST(sum(x.v * y.v) AS BIGINT) AS v FROM a x JOIN a y ON x.j = y.i WHERE y.i < 64 GROUP BY x.i, y.j")
def tile_gemm(s, d):
    """All vectors times the square matrix of the first 64, which is as many as a vector has components."""
    c = cells(s, d)
    return U.multiply_blocks(c, c.filter("i < 64"))


@query(f"""WITH {CELLS}, w AS (SELECT i - 30 + 100 AS i, j - 4 + 12 AS j, v FROM a WHERE i BETWEEN 30 AND 229 AND j BETWEEN 4 AND 43)
SELECT a.i, a.j, CASE WHEN w.i IS NOT NULL THEN w.v ELSE -a.v END AS v FROM a LEFT JOIN w ON a.i = w.i AND a.j = w.j""")
def tile_redistribute(s, d):
    c = cells(s, d)
    last = c.agg(F.max("i"), F.max("j")).first()
    shape = (last[0] + 1, last[1] + 1)
    return M.redistribute(c, c.select("i", "j", (-F.col("v")).alias("v")), 200, 40, (30, 4), (100, 12), shape, shape)


@query(f"""WITH {CELLS}, t AS (SELECT i // 10 AS m, j // 16 AS n, sum(v) AS s FROM a GROUP BY ALL)
SELECT t.m, t.n, CAST(coalesce(u.s, t.s) AS BIGINT) AS tile FROM t LEFT JOIN t u ON t.m = u.m + 3 AND t.n = u.n + 1""")
def tile_reshuffle(s, d):
    t = M.with_tiles(cells(s, d), 10, 16).groupBy("m", "n").agg(F.sum("v").alias("tile"))
    return M.reshuffle(t, t, 3, 1)


@query(f"WITH {CELLS} SELECT n AS receiver, v FROM generate_series(0, 15) x(n), a WHERE i = 3 AND j = 2")
def tile_broadcast(s, d):
    return M.broadcast_root(cells(s, d).select("i", "j", "v"), F.expr("i = 3 AND j = 2"), s.range(16).withColumnRenamed("id", "receiver")).select("receiver", "v")


@query(f"WITH {CELLS} SELECT i, k, v FROM a, generate_series(0, 8, 2) x(k) WHERE j = 0")
def tile_multicast(s, d):
    return cells(s, d).filter("j = 0").select("i", F.explode(F.expr("sequence(0L, 8L, 2L)")).alias("k"), "v")


@query(f"WITH {CELLS} SELECT i, k, j, v FROM a, generate_series(0, 3) x(k) WHERE j < CASE WHEN k = 0 THEN 3 ELSE 2 END")
def tile_multisize(s, d):
    return cells(s, d).select("i", F.explode(F.expr("sequence(0L, 3L)")).alias("k"), "j", "v").filter("j < CASE WHEN k = 0 THEN 3 ELSE 2 END")


@query("SELECT vec_id AS i, CAST(round(x::DOUBLE * 1000000) AS BIGINT) AS v, j FROM (SELECT vec_id, unnest(embedding[5:8]) AS x, unnest(generate_series(0, 3)) AS j FROM embeddings)")
def tile_slice(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("i"), F.posexplode(F.slice("embedding", 5, 4)).alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.round(F.col("x").cast("double") * 1000000).cast("long").alias("v"))


_ONE = "SELECT i, j, 4 * v + coalesce(lead(v) OVER w, 0) * 2 - coalesce(lag(v) OVER w, 0) * 2 AS v FROM {0} WINDOW w AS (PARTITION BY i ORDER BY j)"


@query(f"WITH {CELLS}, b AS ({_ONE.format('a')}) {_ONE.format('b')}")
def stencil_1d(s, d):
    return M.stencil(cells(s, d), {0: 4, 1: 2, -1: -2}, rounds=2)


@query("SELECT r, s, t FROM generate_series(0, 2) x(r), generate_series(0, 24) y(s), generate_series(0, 24) z(t)")
def all_to_all(s, d):
    return M.all_to_all(s.range(25), 3).select(F.col("r").cast("long").alias("r"), "s", "t")


@query(f"WITH {CELLS} SELECT i, j, CAST(sum(v) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM a")
def chain_scan(s, d):
    from weftspark.operators.trace import running_total

    return running_total(cells(s, d), ["i"], "v", "j", "j").select("i", "j", F.col("total").alias("v"))


@query("SELECT k AS hop, k % 7 AS rank, (k + 1) % 7 AS next FROM generate_series(0, 99) x(k)")
def ping_pong(s, d):
    return s.range(100).select(F.col("id").alias("hop"), (F.col("id") % 7).alias("rank"), ((F.col("id") + 1) % 7).alias("next"))


def _owner(name: str, column, sql: str) -> None:
    query(f"WITH {TILES} SELECT m, n, {sql} AS owner FROM t", f"tile_owner_{name}")(lambda s, d: tiles(s).select("m", "n", column(F.col("m"), F.col("n")).alias("owner")))


_G = Grid(2, 3, 1, 2)
_PAIR = "greatest({0}, {1}) * (greatest({0}, {1}) - 1) // 2 + least({0}, {1})"
_owner("2dbc", lambda m, n: P.block_cyclic(m, n, _G, 1, 1), "(m + 1 + 1) % 2 * 3 + (n + 1 + 2) % 3")
_owner("kcyclic", lambda m, n: P.k_cyclic(m, n, Grid(2, 3), 4, 2), "m // 4 % 2 * 3 + n // 2 % 3")
_owner("sym", lambda m, n: P.symmetric(m, n, Grid(2, 3)), "CASE WHEN m >= n THEN m % 2 * 3 + n % 3 END")
_owner("sbc", lambda m, n: P.symmetric_block_cyclic(m, n, 6), f"CASE WHEN m >= n THEN CASE WHEN m % 6 <> n % 6 THEN {_PAIR.format('m % 6', 'n % 6')} ELSE 15 + m % 6 % 3 END END")
_owner("sbc_extended", lambda m, n: P.symmetric_block_cyclic(m, n, 5, extended=True), f"CASE WHEN m >= n THEN CASE WHEN m % 5 <> n % 5 THEN {_PAIR.format('m % 5', 'n % 5')} WHEN m % 5 < 4 - n // 5 % 2 THEN {_PAIR.format('m % 5', '(m % 5 + n // 5 % 2 + 1)')} ELSE {_PAIR.format('(m % 5 + n // 5 % 2 + 1 - 5)', 'm % 5')} END END")
_owner("band", lambda m, n: P.band(m, n, 3, Grid(1, 4), Grid(2, 3)), "CASE WHEN abs(m - n) < 3 THEN n % 4 ELSE m % 2 * 3 + n % 3 END")
_owner("sym_band", lambda m, n: P.symmetric_band(m, n, 3, Grid(1, 4), Grid(2, 3)), "CASE WHEN m >= n THEN CASE WHEN abs(m - n) < 3 THEN n % 4 ELSE m % 2 * 3 + n % 3 END END")
_owner("vector_row", lambda m, n: P.vector(m, Grid(2, 3), "row"), "m % 2 * 3")
_owner("vector_col", lambda m, n: P.vector(m, Grid(2, 3), "col"), "m % 3")
_owner("vector_diag", lambda m, n: P.vector(m, Grid(2, 3), "diag"), "m % 2 * 3 + m % 3")
_owner("virtual", lambda m, n: P.within_node(m, n, Grid(2, 3), 2, 2), "m // 2 % 2 * 2 + n // 3 % 2")
_owner("kview", lambda m, n: P.k_view(m, 2, 3, 40), "CASE WHEN m - m % 6 + m % 3 * 2 + m // 3 % 2 < 40 THEN m - m % 6 + m % 3 * 2 + m // 3 % 2 ELSE (m - m % 6 + m % 3 * 2 + m // 3 % 2) - (m - m % 6 + m % 3 * 2 + m // 3 % 2) % 6 + (m - m % 6 + m % 3 * 2 + m // 3 % 2) % 3 * 2 + (m - m % 6 + m % 3 * 2 + m // 3 % 2) // 3 % 2 END")


@query(f"WITH {TILES}, o AS (SELECT k AS key, k * 7 % 11 AS owner FROM generate_series(0, 1599, 3) x(k)) SELECT m, n, owner FROM t LEFT JOIN o ON n * 40 + m = key")
def tile_owner_tabular(s, d):
    return P.tabular(tiles(s), s.range(0, 1600, 3).select(F.col("id").alias("key"), (F.col("id") * 7 % 11).alias("owner")), 40)


@query(f"WITH {TILES}, o AS (SELECT k AS m, k % 5 AS owner FROM generate_series(0, 39, 2) x(k)) SELECT t.m, n, coalesce(owner, 8) AS owner FROM t LEFT JOIN o ON t.m = o.m")
def tile_owner_hash(s, d):
    return P.hashed(tiles(s), s.range(0, 40, 2).select(F.col("id").alias("m"), (F.col("id") % 5).alias("owner")), "m", 8)


@query(f"WITH {TILES} SELECT m, n, '(' || m || ', ' || n || ')' AS label, n * 40 + m AS key, least(16, 630 - m * 16) AS height FROM t")
def tile_geometry(s, d):
    from weftspark.functions.scalars import tile_label

    return tiles(s).select("m", "n", tile_label(F.col("m"), F.col("n")).alias("label"), (F.col("n") * 40 + F.col("m")).alias("key"), F.least(F.lit(16), 630 - F.col("m") * 16).alias("height"))


_owner("sbc_extended_even", lambda m, n: P.symmetric_block_cyclic(m, n, 6, extended=True), f"""CASE WHEN m >= n THEN CASE WHEN m % 6 <> n % 6 THEN {_PAIR.format('m % 6', 'n % 6')} ELSE
list_extract(CASE n // 6 % 5 WHEN 0 THEN [0, 2, 5, 9, 14, 10] WHEN 1 THEN [1, 4, 8, 13, 6, 11] WHEN 2 THEN [3, 7, 12, 9, 14, 10] WHEN 3 THEN [0, 2, 5, 13, 6, 11] ELSE [1, 4, 8, 3, 7, 12] END, CAST(m % 6 AS INTEGER) + 1) END END""")


@query(f"WITH {TILES} SELECT m, n, CAST(m // 3 AS BIGINT) AS row, CAST(m % 3 AS BIGINT) AS col FROM t")
def tile_grid_position(s, d):
    """A rank's row and column in a grid of three columns; the rank is the tile's row here."""
    row, col = Grid(14, 3).position(F.col("m"))
    return tiles(s).select("m", "n", row.alias("row"), col.cast("long").alias("col"))


@query(f"""WITH {TILES}, v AS (SELECT m, n, m - m % 8 + m % 4 * 2 + m // 4 % 2 AS vm, n - n % 6 + n % 2 * 3 + n // 2 % 3 AS vn FROM t),
w AS (SELECT m, n, CASE WHEN vm < 40 THEN vm ELSE vm - vm % 8 + vm % 4 * 2 + vm // 4 % 2 END AS vm, CASE WHEN vn < 40 THEN vn ELSE vn - vn % 6 + vn % 2 * 3 + vn // 2 % 3 END AS vn FROM v)
SELECT m, n, m % 2 * 3 + n % 3 AS plain, m // 4 % 2 * 3 + n // 2 % 3 AS cyclic, vm % 2 * 3 + vn % 3 AS viewed FROM w""")
def tile_k_cyclic_views(s, d):
    """Owners in a plain distribution, in a k-cyclic copy, and in a k-cyclic view of the plain one."""
    m, n, g = F.col("m"), F.col("n"), Grid(2, 3)
    seen = P.block_cyclic(P.k_view(m, 2, 4, 40), P.k_view(n, 3, 2, 40), g)
    return tiles(s).select("m", "n", P.block_cyclic(m, n, g).alias("plain"), P.k_cyclic(m, n, g, 4, 2).alias("cyclic"), seen.alias("viewed"))


@query(f"WITH {TILES} SELECT m, n, CASE WHEN m > n THEN 'lower' WHEN m < n THEN 'upper' ELSE 'diagonal' END AS kind, CASE WHEN abs(m - n) < 3 THEN m - n + 2 END AS r, CASE WHEN abs(m - n) < 3 THEN m * 100 + n ELSE 0 END AS v FROM t")
def tile_band_fill(s, d):
    """Tiles of a band matrix by the part they are of, the row they have in the band's storage, and what they are filled with."""
    m, n = F.col("m"), F.col("n")
    inside = P.in_band(m, n, 3)
    kind = F.when(m > n, "lower").when(m < n, "upper").otherwise("diagonal")
    return tiles(s).select("m", "n", kind.alias("kind"), F.when(inside, m - n + 2).alias("r"), F.when(inside, m * 100 + n).otherwise(0).alias("v"))


@query(f"WITH {CELLS} SELECT i, j, CAST(v AS DOUBLE) AS v FROM a WHERE i >= j")
def tile_reshape_lower(s, d):
    """The lower triangle alone, as doubles."""
    return M.reshape(cells(s, d), M.LOWER, "double")


@query(f"WITH {CELLS} SELECT i, j, CASE WHEN i // 16 > j // 16 OR (i // 16 = j // 16 AND i >= j) THEN max(v) OVER (PARTITION BY i // 16, j // 16) - v ELSE v END AS v FROM a")
def udf_tile_apply(s, d):
    """A Python operator on the lower triangle's tiles: how far each cell is below its tile's largest."""
    return U.from_tiles(U.map_tiles(U.to_tiles(cells(s, d), 16, 16), lambda m, n, a, b, v: v.max() - v, M.LOWER), 16, 16)


@query(f"WITH {CELLS} SELECT i % 16 AS a, j % 16 AS b, max(v) AS v FROM a GROUP BY ALL")
def udf_tile_reduce(s, d):
    """A Python function as the reduction of all tiles."""
    return U.reduce_opaque(cells(s, d), 16, 16, lambda x, y: x if x > y else y)


@query("SELECT i, j, CASE WHEN j % 3 = 0 THEN 'device' WHEN i % 2 = 0 THEN 'cpu' END AS ran, CASE WHEN j % 3 = 0 THEN (i + 1) * (j + 1) * 30 WHEN i % 2 = 0 THEN i + j + 10 END AS result FROM generate_series(0, 19) x(i), generate_series(0, 9) y(j)")
def udf_task_bodies(s, d):
    """Bodies of tasks in Python: the first that takes a task runs it; parameters arrive as they were given."""
    from weftspark.operators import graph as G

    bodies = {"device": (lambda t: t["j"] % 3 == 0, lambda t: (t["i"] + 1) * (t["j"] + 1) * t["given"]["c"]), "cpu": (lambda t: t["i"] % 2 == 0, lambda t: t["i"] + t["j"] + t["data1"])}
    return U.run_bodies(G.task_space(s, i=(0, 19), j=(0, 9)), bodies, "long", data1=10, given={"a": 1, "b": 20, "c": 30})


@query("SELECT p_partkey AS id, p_size * p_size % 7 + length(p_brand) AS value FROM part")
def function_inline(s, d):
    """An expression in Python over whole columns."""
    from weftspark.functions.scalars import inline

    own = inline(_own_expression, "long")
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), own(F.col("p_size").cast("long"), F.length("p_brand").cast("long")).alias("value"))


def _own_expression(size: pd.Series, length: pd.Series) -> pd.Series:
    return size * size % 7 + length


@query("SELECT t AS tiles, l AS level, i, CASE WHEN i < (t + (1 << l) - 1) // (1 << l) - 1 THEN 5 * (1 << l) WHEN i = (t + (1 << l) - 1) // (1 << l) - 1 THEN t * 5 - 5 * (1 << l) * i END AS size FROM generate_series(1, 40) x(t), generate_series(0, 6) y(l), generate_series(0, 39) z(i) WHERE i < (t + (1 << l) - 1) // (1 << l)")
def function_merge_tree(s, d):
    """Sizes of the nodes of merge trees of 1 to 40 tiles of five values."""
    from weftspark.functions.scalars import merged_size, width_at_level

    t = s.range(1, 41).select(F.col("id").alias("tiles"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("level"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), width_at_level(F.col("level"), F.col("tiles")) - 1)))
    return t.withColumn("size", merged_size(F.col("level"), F.col("i"), 5, F.col("tiles")))
