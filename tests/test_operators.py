import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftspark.functions import placement, scalars
from weftspark.operators import graph, tiles, trace, udf
from weftspark.sources import sinks


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4


def test_starts_take_the_next_record_or_an_end_that_is_no_start_s_next(spark):
    rows = [(1, 0, 10, "s"), (2, 0, 11, "s"), (3, 0, 12, "e"), (4, 0, 13, "s"), (5, 1, 1, "e"), (6, 2, 1, "s"), (7, 2, 2, "s"), (8, 2, 3, "x"), (9, 2, 4, "e")]
    df = spark.createDataFrame(rows, "id long, stream long, time long, type string")
    p = trace.pair_intervals(df, ["stream"], F.col("type") == "s", F.col("type") == "e")
    # The end at 12 is the next record of the start at 11, so that at 10 can't have it; the one at 4 serves two.
    assert sorted((r.id, r.begin, r.end) for r in p.collect()) == [(1, 10, None), (2, 11, 12), (4, 13, None), (6, 1, 4), (7, 2, 4)]
    assert {r.id: r.error for r in trace.interval_errors(p, 2).collect()} == {1: "no matching end", 2: None, 4: "no matching end", 6: "unreasonable duration", 7: None}


def test_memory_is_given_back_once_and_by_size_of_its_allocation(spark):
    rows = [(1, 0, 10, 7, "m", 5), (2, 0, 11, 7, "f", 99), (3, 0, 12, 7, "f", 1), (4, 0, 13, 8, "m", 0), (5, 0, 14, 8, "f", 3), (6, 0, 15, 9, "m", 4), (7, 0, 16, 9, "m", 6), (8, 0, 17, 9, "f", 0)]
    df = spark.createDataFrame(rows, "id long, node long, time long, ptr long, type string, size long")
    out = trace.memory_timeline(df, ["node"], "ptr", F.col("type") == "m", "size", width=3)
    assert [(r.id, r.change, r.total) for r in out.orderBy("time").collect()] == [(1, 5, 5), (2, -5, 0), (6, 4, 4), (7, 6, 10), (8, -6, 4)]


def test_buckets_do_not_change_results(spark):
    rows = [(i, i % 2, (i * 37) % 101, (i * 13) % 17) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, node long, time long, y long")
    for width in (1, 7, 1000):
        totals = trace.running_total(df, ["node"], "y", width=width)
        slopes = trace.derivative(df, ["node"], "time", "y", width=width)
        spans = trace.clip(df.select("id", "node", F.col("time").alias("begin"), (F.col("time") + F.col("y")).alias("end")), ["node"], width=width)
        quarts = trace.quantiles(df, "node", "y", {"q1": 0.25, "q3": 0.75}, width)
        got = [sorted(map(tuple, x.collect()), key=str) for x in (totals, slopes, spans, quarts)]
        if width == 1:
            want = got
        assert got == want


def _paired_plainly(rows):
    """Starts and their ends by the rule, a record at a time: (id, begin, end)."""
    fits = lambda a, b: a[3] == "s" and b[3] == "e" and a[4] == b[4] and b[2] >= a[2]
    out = []
    for node in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == node), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(own):
            if r[3] == "s":
                free = (own[j] for j in range(i + 1, len(own)) if fits(r, own[j]) and not fits(own[j - 1], own[j]))
                found = own[i + 1] if i + 1 < len(own) and fits(r, own[i + 1]) else next(free, None)
                out.append((r[0], r[2], found and found[2]))
    return sorted(out)


def test_buckets_look_past_their_edges(spark):
    """Neighbours, ends, errors and freed memory are the same in buckets of any width; a null key is a key."""
    pick = [(i * 7919 + 31) % 1009 for i in range(240)]
    rows = [(i, (None, 0, 0, 1)[p % 4], (i * 53) % 211, "ssexm"[p % 5], p % 3, p % 50) for i, p in enumerate(pick)]
    df = spark.createDataFrame(rows, "id long, node long, time long, type string, same long, size long")
    is_start, is_end = F.col("type") == "s", F.col("type") == "e"
    want = None
    assert trace.width_for(df, ["node"], 5, 200) is None and trace.width_for(df, ["node"], 5, 20) == 5
    for width in (None, 1, 9, 10**6):
        pairs = trace.pair_intervals(df, ["node"], is_start, is_end, ("same",), width=width).select("id", "begin", "end")
        checked = trace.validate(df, F.col("type") != "x", ["node"], "id", width=width).select("id", "error")
        nexts = trace.next_match(df, ["node", "same"], ["type", "time"], width=width).select("id", "next_type", "next_time")
        memory = trace.memory_timeline(df.filter("node IS NOT NULL"), ["node"], "same", is_start, "size", width=width or 3).select("id", "change", "total")
        got = [sorted(map(tuple, x.collect()), key=str) for x in (pairs, checked, nexts, memory)]
        want = want or got
        assert got == want
    assert sorted(want[0]) == _paired_plainly(rows)
    past, errors = {}, {}
    for i, node, time, kind, *_ in rows:
        errors[i] = "unknown type" if kind == "x" else "before its predecessor" if time < past.get(node, -1) else None
        if kind != "x":
            past[node] = max(past.get(node, -1), time)
    assert dict(want[1]) == errors


def _ended_elsewhere_plainly(rows, of_own):
    """``of_own`` with the ends of other streams, a start at a time; rows are (id, node, stream, time, type, same)."""
    fits = lambda a, b: a[4] in "sb" and b[4] in "eb" and a[5] == b[5] and b[3] >= a[3]
    threads = {t: sorted((r for r in rows if r[1:3] == t), key=lambda r: (r[3], r[0])) for t in {r[1:3] for r in rows}}
    free = [own[j] for own in threads.values() for j in range(len(own)) if own[j][4] in "eb" and not (j and fits(own[j - 1], own[j]))]
    at = {r[0]: r for r in rows}
    for i, begin, end in of_own:
        s = at[i]
        there = [(f[2], f[3]) for f in free if None not in (s[2], f[2], *s[1:2], s[5]) and f[1] == s[1] and f[2] != s[2] and f[5] == s[5] and f[3] >= s[3]]
        yield i, begin, end if end is not None else min(there, default=(None, None))[1]


def test_ends_of_other_threads_are_found_without_pairs(spark):
    """A file's starts and ends never meet as pairs; ends are those by the rule, in buckets of any width."""
    r = random.Random(5)
    rows = [(i, r.choice([None, 0, 0, 1]), r.choice([*range(25), None]), r.randrange(50), r.choice("sssexmb"), r.choice([0, 1, 2, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, node long, stream long, time long, type string, same long")
    marks = F.col("type").isin("s", "b"), F.col("type").isin("e", "b")
    own = sorted(map(tuple, trace.pair_intervals(df, ["node", "stream"], *marks, ("same",)).select("id", "begin", "end").collect()))
    want = list(_ended_elsewhere_plainly(rows, own))
    assert sum(a != b for a, b in zip(own, want, strict=True)) > 50
    for width in (None, 1, 9, 10**6):
        found = trace.pair_intervals(df, ["node", "stream"], *marks, ("same",), ["node"], width=width)
        assert {*found.columns} == {*df.columns, "begin", "end"}
        assert sorted(map(tuple, found.select("id", "begin", "end").collect())) == want, width
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_dependencies_look_past_the_edges_of_buckets(spark):
    rows = [((i * 7919) % 3, i, ("R", "R", "W", "RW", "-")[(i * i * 31 + i) % 5]) for i in range(150)]
    df = spark.createDataFrame(rows, "tile long, seq long, op string")
    last, since, want = {}, {}, []
    for tile, seq, op in rows:
        if "R" in op and tile in last:
            want.append((last[tile], seq, tile, "RAW"))
        if "W" in op:
            want += [(last[tile], seq, tile, "WAW")] if tile in last else []
            want += [(r, seq, tile, "WAR") for r in since.pop(tile, [])]
            last[tile] = seq
        elif op == "R":
            since.setdefault(tile, []).append(seq)
    for width in (1, 20, 1 << 20):
        assert sorted(tuple(r) for r in graph.infer_dependencies(df, width=width).collect()) == sorted(want)


def test_products_of_blocks(spark):
    a = spark.createDataFrame([(i, k, i * 7 - k) for i in range(5) for k in range(6) if (i + k) % 3], "i long, j long, v long")
    b = spark.createDataFrame([(k, j, k - 2 * j) for k in range(6) for j in range(4) if k != 2], "i long, j long, v long")
    want = {(r.i, r.j): r.v for r in tiles.multiply(a, b).collect()}
    for block in (2, 3, 64):
        assert {(r.i, r.j): r.v for r in udf.multiply_blocks(a, b, block).collect()} == want


def test_a_task_holds_few_tiles_as_it_maps_them(spark):
    """The memory of a task's Python doesn't grow with the tiles of a batch."""
    cell = "struct(CAST(x div 16 AS int) AS a, CAST(x % 16 AS int) AS b, id * 256 + x AS v)"
    some = spark.range(6000).coalesce(1).select(F.col("id").alias("m"), (F.col("id") % 2).alias("n"), F.expr(f"transform(sequence(0L, 255L), x -> {cell})").alias("tile"))

    def held(m, n, a, b, v):
        with open("/proc/self/statm") as f:
            return np.full(len(v), int(f.read().split()[1]) * 4096)

    seen = udf.map_tiles(some, held).select(F.col("tile")[0].v.alias("v")).agg(F.min("v"), F.max("v")).first()
    assert seen[1] - seen[0] < 100e6


@pytest.mark.parametrize("most", [1, 7, 1 << 18])
def test_mapped_tiles_keep_their_cells(spark, most):
    """Tiles of several sizes, an empty one among them; a value that isn't whole is cut, one too few is refused."""
    rows = [(m, n, [(a, b, 100 * m + 10 * a + b) for a in range(m) for b in range(3)]) for m in range(5) for n in range(5)]
    some = spark.createDataFrame(rows, "m long, n long, tile array<struct<a: int, b: int, v: long>>").coalesce(1)
    for kind in ("full", "lower", "upper"):
        inside = lambda m, n, a, b: kind == "full" or (m > n if kind == "lower" else m < n) or m == n and (a >= b if kind == "lower" else a <= b)  # noqa: B023, E731
        want = sorted((m, n, [(a, b, 2 * v + m if inside(m, n, a, b) else v) for a, b, v in tile]) for m, n, tile in rows)
        got = udf.map_tiles(some, lambda m, n, a, b, v: 2 * v + m + 0.5, kind, most).collect()
        assert sorted((r.m, r.n, [tuple(c) for c in r.tile]) for r in got) == want
    with pytest.raises(Exception, match="ValueError"):
        udf.map_tiles(some, lambda m, n, a, b, v: v[1:], most=most).collect()


def test_owners_on_the_extended_diagonal_use_all_pairs(spark):
    for r in (4, 5, 6, 7, 8):
        t = spark.range(r * r).select(F.col("id").alias("m"))
        rows = t.select(placement.symmetric_block_cyclic(F.col("m"), F.col("m"), r, extended=True).alias("o")).groupBy("o").count().collect()
        assert {x.o for x in rows} <= set(range(r * (r - 1) // 2))
        # Each pattern of an odd r has each pair of its step once; over all patterns every pair comes equally often.
        patterns = r - 1 if r % 2 == 0 else (r - 1) // 2
        whole = spark.range(r * patterns).select(placement.symmetric_block_cyclic(F.col("id"), F.col("id"), r, extended=True).alias("o")).groupBy("o").count().collect()
        assert len(whole) == r * (r - 1) // 2 and len({x["count"] for x in whole}) == 1


def test_large_numbers_are_divided_exactly(spark):
    big = 2**62 + 12345
    df = spark.createDataFrame([(big,)], "m long")
    r = df.select(scalars.divide(F.col("m"), F.lit(3)).alias("a"), placement._div(-F.col("m"), 7).alias("b"), placement.k_view(F.lit(39), 2, 16, 40).alias("c")).first()
    assert r.a == big // 3 and r.b == -big // 7 and 0 <= r.c < 40


def test_moved_null_tiles_stay_null(spark):
    a = spark.createDataFrame([(0, 0, None), (0, 1, 3)], "m long, n long, tile long")
    b = spark.createDataFrame([(1, 1, 7), (1, 2, 8), (2, 2, 9)], "m long, n long, tile long")
    assert sorted(tuple(r) for r in tiles.reshuffle(a, b, 1, 1, (2, 2, 2, 2)).collect()) == [(1, 1, None), (1, 2, 3), (2, 2, 9)]
    with pytest.raises(ValueError, match="sizes"):
        tiles.reshuffle(a, b, 1, 1, (2, 2, 2, 3))
    assert tiles.window_is_stored(3, 2, (5, 1), lower=True) and not tiles.window_is_stored(3, 2, (1, 1), lower=True)


def test_random_owners_are_stable_and_in_range(spark):
    own = lambda: [r.o for r in spark.range(500).select(placement.random_owner(F.col("id"), F.col("id") + 1, 7, 3).alias("o")).collect()]
    assert own() == own() and set(own()) == set(range(7))


def test_paje_and_dumped_graphs(spark, tmp_path):
    i = spark.createDataFrame([(0, 2, 1000, 3000, "a"), (1, 3, 500, 900, "b")], "node long, stream long, begin long, end long, name string")
    c = spark.createDataFrame([(0, 700, 5)], "node long, time long, change long")
    k = spark.createDataFrame([(0, 2, 3000, 1, 3, 3100, 1)], "from_node long, from_stream long, begin long, to_node long, to_stream long, end long, key long")
    sinks.write_paje(i, str(tmp_path / "p"), c, k)
    lines = [r.value for r in spark.read.text(str(tmp_path / "p")).coalesce(1).collect()]
    at = {x: n for n, x in enumerate(lines)}
    assert lines[: len(sinks.PAJE)] == sinks.PAJE and lines[-1] == '8 3100 L_C C_Appli P1T3 "" "1"'
    assert at['4 0.0 P0 CT_P C_Appli "Process 0"'] < at['4 0.0 P0T2 CT_T P0 "Thread 2"'] < at['5 500 ST_T P1T3 "b"'] < at["6 700 V_P P0 5"] < at['5 3000 ST_T P0T2 "Waiting"']
    tasks = spark.createDataFrame([("T_0", 1, 0, "GEMM", "3, 4", "loc", 7, 2, 5, "gemm", 9), ("T_1", 0, 0, "TRSM", "1", "", 0, 2, 6, "trsm", 10)], "name string, thid int, vpid int, label string, param string, local string, prio int, tpid int, tcid int, tcname string, tid int")
    edges = spark.createDataFrame([("T_0", "T_1", "C", "A", "00FF00", "solid")], "src string, dst string, flow_src string, flow_dst string, color string, style string")
    sinks.write_dot(tasks, edges, str(tmp_path / "g"))
    text = [r.value for r in spark.read.text(str(tmp_path / "g")).coalesce(1).collect()]
    assert text[0] == "digraph G {" and text[-1] == "}"
    a, b = sinks.read_task_graph(spark, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in a.collect()) == [("T_0", 1, 0, "GEMM", "3, 4", "loc", 7, 2, 2, 5, "gemm", 9), ("T_1", 0, 0, "TRSM", "1", "", 0, 2, 2, 6, "trsm", 10)]
    assert [tuple(r) for r in b.collect()] == [("T_0", "T_1", "C", "A", "00FF00", "solid")]
    (tmp_path / "bad").write_text("digraph G {\nwhat is this\n}\n")
    with pytest.raises(Exception, match="neither a task nor a link"):
        sinks.read_task_graph(spark, str(tmp_path / "bad"))[0].collect()


def test_conditions_are_compared_not_run(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ".x")], "id long, name string")
    assert [r.id for r in trace.filter_events(df, "name==.x").collect()] == [2]
    with pytest.raises(ValueError, match="condition"):
        trace.filter_events(df, "__import__('os')")


def test_windows_are_checked(spark):
    c = spark.createDataFrame([(0, 0, None), (1, 1, 5)], "i long, j long, v long")
    t = spark.createDataFrame([(0, 0, 7), (1, 1, 8)], "i long, j long, v long")
    assert sorted(tuple(r) for r in tiles.redistribute(c, t, 2, 2, (0, 0), (0, 0), (2, 2), (2, 2)).collect()) == [(0, 0, None), (1, 1, 5)]
    for bad in ((3, 2, (0, 0), (0, 0)), (0, 1, (0, 0), (0, 0)), (1, 1, (-1, 0), (0, 0))):
        with pytest.raises(ValueError, match="window"):
            tiles.redistribute(c, t, *bad, (2, 2), (2, 2))
    with pytest.raises(ValueError, match="radius"):
        tiles.stencil(c, {0: 1.0})


def test_small_helpers():
    assert tiles.forest_of(13) == [(1, 0), (4, 1), (8, 5)]
    assert tiles.standard_weights(2) == {0: 1.0, 1: 0.25, -1: -0.25, 2: 0.125, -2: -0.125}
    assert scalars.common_substring(["xabcy", "zabc", "abcd"]) == "abc" and scalars.common_substring([]) == ""
    assert scalars.parse_range("1:7:3") == [1, 4, 7] and scalars.parse_range("5") == [5]
    assert scalars.lookup_alias(["PARAM_N", "M"], "n") == "PARAM_N"
    assert scalars.replace_last("a.b.c", ".", "-") == "a.b-c" and [scalars.tree_height(n) for n in (1, 2, 3, 4, 5)] == [0, 1, 2, 2, 3]
    assert sorted(graph.topological_orders([1, 2, 3], [(1, 3)])) == [[1, 2, 3], [1, 3, 2], [2, 1, 3]]


def test_sinks_round_trip(spark, tmp_path):
    i = spark.createDataFrame([(1, 0, 2, 1000, 3000, "a"), (2, 0, 2, 4000, 9000, "SYS b")], "id long, node long, stream long, begin long, end long, name string")
    sinks.write_chrome(i, str(tmp_path / "c"), skip=("SYS",))
    assert [(r["name"], r.ts, r.dur) for r in spark.read.json(str(tmp_path / "c")).collect()] == [("a", 1.0, 2.0)]
    sinks.write_xml(i, str(tmp_path / "x"))
    assert spark.read.format("xml").option("rowTag", "thread").load(str(tmp_path / "x")).count() == 1
    tasks = spark.createDataFrame([("t1", "A"), ("t2", "B")], "id string, label string")
    edges = spark.createDataFrame([("t1", "t2", "X")], "src string, dst string, flow string")
    sinks.write_dot(tasks, edges, str(tmp_path / "d"))
    a, b = sinks.read_dot(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, a.collect())) == [("t1", "A"), ("t2", "B")] and [tuple(r) for r in b.collect()] == [("t1", "t2", "X")]
    cells = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 1)], "i long, j long, v long, owner int")
    sinks.write_tiles(cells, str(tmp_path / "m"))
    assert sorted(map(tuple, sinks.read_tiles(spark, str(tmp_path / "m")).select("i", "j", "v", "owner").collect())) == [(0, 0, 1, 0), (0, 1, 2, 1)]


def test_division_cuts_towards_nought(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (1, 0)], "a long, b long").select(scalars.divide(F.col("a"), F.col("b")).alias("q"))
    assert [r.q for r in df.collect()] == [3, -3, -3, None]


def test_matrix_product_adds_to_c(spark):
    m = spark.createDataFrame([(0, 0, 2), (0, 1, 3)], "i long, j long, v long")
    assert {(r.i, r.j): r.v for r in tiles.multiply(m, m, m).collect()} == {(0, 0): 6, (0, 1): 9}
