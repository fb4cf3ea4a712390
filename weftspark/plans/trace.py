"""Trace queries over the events table, and the same in SQL.

user_id is the stream, user_id % 4 the node, view begins and purchase ends an interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.operators import trace as T

MINUTE = 60_000_000
EV = "ev AS (SELECT event_id AS id, user_id AS stream, user_id % 4 AS node, event_type AS type, epoch_us(ts) AS time, CAST(round(value * 100) AS BIGINT) AS size, event_id % 50 AS ptr FROM events)"
NB = "nb AS (SELECT *, lead(type) OVER w AS nt, lead(time) OVER w AS ntime, lag(type) OVER w AS pt FROM ev WINDOW w AS (PARTITION BY stream ORDER BY time, id))"
STOP = "CASE WHEN type = 'view' AND nt = 'purchase' THEN ntime ELSE min(CASE WHEN type = 'purchase' AND coalesce(pt, '') <> 'view' THEN time END) OVER (PARTITION BY stream ORDER BY time, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS stop"
IV = EV + f""", {NB}, pr AS (SELECT *, {STOP} FROM nb),
iv AS (SELECT id, stream, node, size, ptr, time AS "begin", stop AS "end" FROM pr WHERE type = 'view' AND stop IS NOT NULL)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("stream"), (F.col("user_id") % 4).alias("node"), F.col("event_type").alias("type"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time"), F.round(F.col("value") * 100).cast("long").alias("size"), (F.col("event_id") % 50).alias("ptr"),
    )


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    p = T.pair_intervals(e, ["stream"], F.col("type") == "view", F.col("type") == "purchase", width=T.width_for(e, ["stream"]))
    return p.filter("end IS NOT NULL").select("id", "stream", "node", "size", "ptr", "begin", "end")


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {IV} SELECT id, stream, \"begin\", \"end\", \"end\" - \"begin\" AS duration FROM iv")
def trace_pair_intervals(s, d):
    return intervals(s, d).select("id", "stream", "begin", "end", (F.col("end") - F.col("begin")).alias("duration"))


@query(f"WITH {EV} SELECT type, count(*) FILTER (WHERE node = 0) AS node_0, count(*) FILTER (WHERE node = 1) AS node_1, count(*) FILTER (WHERE node = 2) AS node_2, count(*) FILTER (WHERE node = 3) AS node_3 FROM ev GROUP BY type")
def trace_type_counts(s, d):
    return T.count_by_node(events(s, d), "type", "node", [0, 1, 2, 3])


DESCRIBE = "count(size) AS n, sum(size)::DOUBLE / count(size) AS mean, round(sqrt((CAST(sum(size * size) AS DOUBLE) - sum(size)::DOUBLE * sum(size) / count(size)) / nullif(count(size) - 1, 0)), 3) AS std, min(size) AS least, quantile_cont(size, 0.25) AS q1, quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3, max(size) AS largest"


@query(f"WITH {EV} SELECT type, {DESCRIBE} FROM ev GROUP BY type")
def trace_describe(s, d):
    return T.describe(events(s, d), "type", "size")


@query(f"""WITH {EV}, a AS (SELECT type, count(size) AS n, sum(size)::BIGINT AS s, CAST(sum(size * size) AS DOUBLE) AS s2 FROM ev GROUP BY type),
v AS (SELECT *, CASE WHEN n > 1 THEN (s2 - s::DOUBLE * s / n) / (n - 1) ELSE 0.0 END AS v FROM a)
SELECT type, n, s::DOUBLE / n AS mean, round(v, 3) AS variance, CAST(trunc(100 * sqrt(greatest(v, 0.0)) / (s::DOUBLE / n)) AS BIGINT) AS rsd FROM v""")
def trace_welford(s, d):
    return T.spread(events(s, d), "type", "size")


@query(f"""WITH {IV}, x AS (SELECT node, stream, min(time) AS "begin" FROM ev WHERE type <> 'error' GROUP BY node, stream), y AS (SELECT node, stream, max("end") AS "end" FROM iv GROUP BY node, stream)
SELECT x.node, x.stream, x."begin", coalesce(y."end", 0) AS "end", coalesce(y."end", 0) - x."begin" AS duration FROM x LEFT JOIN y ON x.node = y.node AND x.stream = y.stream""")
def trace_stream_extents(s, d):
    accepted = T.validate(events(s, d), F.col("type") != "error", ["node", "stream"], "time").filter("error IS NULL")
    return T.extents(accepted, intervals(s, d), ["node", "stream"])


_INFO = "info AS (SELECT DISTINCT node, 'k' || CAST(ptr AS VARCHAR) AS key, CASE WHEN ptr % 3 = 0 THEN ptr WHEN ptr % 3 = 1 AND node < 2 THEN 0 ELSE node * (ptr % 5) END AS value FROM ev)"


def _info(s, d):
    value = F.when(F.col("ptr") % 3 == 0, F.col("ptr")).when((F.col("ptr") % 3 == 1) & (F.col("node") < 2), 0).otherwise(F.col("node") * (F.col("ptr") % 5))
    return events(s, d).select("node", F.concat(F.lit("k"), F.col("ptr").cast("string")).alias("key"), value.cast("long").alias("value")).distinct()


@query(f"WITH {EV}, {_INFO} SELECT i.key, i.value::BIGINT AS value FROM info i WHERE i.node = 0 AND NOT EXISTS (SELECT 1 FROM info o WHERE o.key = i.key AND o.node <> 0 AND o.value <> 0 AND o.value <> i.value)")
def trace_common_info(s, d):
    return T.common_information(_info(s, d))


@query(f"WITH {EV}, {_INFO}, g AS (SELECT key, count(DISTINCT node) AS r, min(value) AS a, max(value) AS b, avg(value) AS m FROM info GROUP BY key) SELECT key, CASE WHEN a = b THEN a::DOUBLE ELSE m END AS value, a = b AS equal FROM g WHERE r = 4")
def trace_merge_info(s, d):
    return T.merge_information(_info(s, d).withColumnRenamed("node", "run"), 4)


@query(f"""WITH {EV}, o AS (SELECT *, (id * 7919) % 10007 * 1000000 + id AS arrival FROM ev),
p AS (SELECT *, max(CASE WHEN type <> 'error' THEN time END) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM o)
SELECT id, stream, CASE WHEN type = 'error' THEN 'unknown type' ELSE 'before its predecessor' END AS error FROM p WHERE type = 'error' OR time < past""")
def trace_out_of_order(s, d):
    e = events(s, d).withColumn("arrival", (F.col("id") * 7919) % 10007 * 1000000 + F.col("id"))
    return T.validate(e, F.col("type") != "error", ["stream"], "arrival").filter("error IS NOT NULL").select("id", "stream", "error")


@query(f"""WITH {EV}, {NB}, p AS (SELECT *, {STOP} FROM nb)
SELECT id, CASE WHEN stop IS NULL THEN 'no matching end' WHEN stop < time OR stop - time > 36000000000 THEN 'unreasonable duration' END AS error FROM p WHERE type = 'view'""")
def trace_interval_errors(s, d):
    e = events(s, d)
    p = T.pair_intervals(e, ["stream"], F.col("type") == "view", F.col("type") == "purchase", width=T.width_for(e, ["stream"]))
    return T.interval_errors(p, 600 * MINUTE).select("id", "error")


@query(f"""WITH {EV}, m AS (SELECT *, lead(type) OVER (PARTITION BY stream, ptr ORDER BY time, id) AS next_type, lead(time) OVER (PARTITION BY stream, ptr ORDER BY time, id) AS next_time FROM ev WHERE type IN ('view', 'purchase'))
SELECT id, stream, ptr, next_time, next_type = 'purchase' AS freed FROM m WHERE type = 'view' AND next_type IS NOT NULL""")
def trace_next_match(s, d):
    e = events(s, d).filter(F.col("type").isin("view", "purchase"))
    m = T.next_match(e, ["stream", "ptr"], ["type", "time"], width=T.width_for(e, ["stream", "ptr"]))
    return m.filter("type = 'view' AND next_type IS NOT NULL").select("id", "stream", "ptr", "next_time", (F.col("next_type") == "purchase").alias("freed"))


@query(f"""WITH {EV}, e AS (SELECT *, lag(type) OVER w AS pt, lag(size) OVER w AS ps FROM ev WHERE type = 'purchase' OR (type = 'view' AND size > 0) WINDOW w AS (PARTITION BY node, ptr ORDER BY time, id)),
c AS (SELECT id, node, time, CASE WHEN type = 'view' THEN size WHEN pt = 'view' THEN -ps END AS change FROM e)
SELECT id, node, change, CAST(sum(change) OVER (PARTITION BY node ORDER BY time, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c WHERE change IS NOT NULL""")
def trace_mem_timeline(s, d):
    e = events(s, d).filter(F.col("type").isin("view", "purchase"))
    return T.memory_timeline(e, ["node"], "ptr", F.col("type") == "view", "size").select("id", "node", "change", "total")


@query(f"""WITH {IV}, c AS (SELECT id, node, "begin" AS time, 0 AS side, size AS change FROM iv UNION ALL SELECT id, node, "end", 1, -size FROM iv)
SELECT id, node, time, side, change, CAST(sum(change) OVER (PARTITION BY node ORDER BY time, side, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM c""")
def trace_counter_timeline(s, d):
    return T.counter_timeline(intervals(s, d), ["node"], "size")


@query(f"""WITH {IV}, c AS (SELECT *, max("end") OVER (PARTITION BY node ORDER BY "begin", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM iv)
SELECT id, node, greatest("begin", coalesce(c, "begin")) AS "begin", "end" FROM c WHERE c IS NULL OR "end" > c""")
def trace_clip_intervals(s, d):
    return T.clip(intervals(s, d), ["node"]).select("id", "node", "begin", "end")


@query(f"""WITH {EV}, p AS (SELECT id, node, time // 1000000 AS x, size AS y FROM ev), l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY node ORDER BY x, id))
SELECT id, node, CASE WHEN abs(dx) > 0.0001 THEN dy::DOUBLE / dx END AS slope FROM l""")
def trace_derivative(s, d):
    p = events(s, d).select("id", "node", F.expr("time div 1000000").alias("x"), F.col("size").alias("y"))
    return T.derivative(p, ["node"], "x", "y").select("id", "node", "slope")


@query(f'WITH {IV} SELECT a.stream, a.id, b.id AS other FROM iv a JOIN iv b ON a.stream = b.stream AND a.id < b.id AND a."begin" <= b."end" AND b."begin" <= a."end"')
def trace_overlap_pairs(s, d):
    return T.overlap_pairs(intervals(s, d), ["stream"], 600 * MINUTE)


@query(f'WITH {IV} SELECT a.node, a.id, b.id AS "outer", a."end" <= b."end" AS whole FROM iv a JOIN iv b ON a.node = b.node AND b.ptr = 7 AND a.ptr <> 7 AND a."begin" BETWEEN b."begin" AND b."end"')
def trace_contained(s, d):
    i = intervals(s, d)
    return T.contained(i.filter("ptr <> 7"), i.filter("ptr = 7"), ["node"], 600 * MINUTE)


@query(f"""WITH {IV}, t AS (SELECT * FROM iv WHERE id % 2 = 0), c AS (SELECT *, size AS delta FROM iv WHERE id % 2 = 1 AND "end" > "begin")
SELECT t.id AS task, CAST(sum(CAST(trunc((least(c."end", t."end") - greatest(c."begin", t."begin"))::DOUBLE / (c."end" - c."begin") * delta) AS BIGINT)) AS BIGINT) AS counted
FROM t JOIN c ON t.stream = c.stream AND c."begin" < t."end" AND c."end" > t."begin" GROUP BY t.id""")
def trace_overlap_attribution(s, d):
    i = intervals(s, d)
    return T.attribute_overlap(i.filter("id % 2 = 0"), i.filter("id % 2 = 1").withColumn("delta", F.col("size")), ["stream"], 600 * MINUTE)


@query(f"WITH {EV} SELECT a.stream, a.ptr, a.id AS send, b.id AS receive, b.time - a.time AS delay FROM ev a JOIN ev b ON a.stream = b.stream AND a.ptr = b.ptr AND a.type = 'click' AND b.type = 'signup'")
def trace_sendrecv(s, d):
    m = T.match_messages(events(s, d), ["stream", "ptr"], "type", "click", "signup")
    return m.select("stream", "ptr", "send", "receive", (F.col("received_at") - F.col("sent_at")).alias("delay"))


@query(f"WITH {EV} SELECT e.id, n.n_name AS name, r.r_name AS \"group\" FROM ev e JOIN nation n ON e.stream % 25 = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def trace_node_lookup(s, d):
    n, r = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/region.parquet")
    e = events(s, d).withColumn("n_nationkey", (F.col("stream") % 25).cast("int"))
    return e.join(n, "n_nationkey").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("id", F.col("n_name").alias("name"), F.col("r_name").alias("group"))


@query(f"WITH {EV} SELECT id, type FROM ev WHERE node = 1 AND type = 'click'")
def trace_filter_conditions(s, d):
    return T.filter_events(events(s, d), "node==1", "type==click").select("id", "type")


@query(f"WITH {EV} SELECT id, type FROM ev WHERE regexp_matches(type, 'c[kt]') OR type = 'view'")
def trace_filter_regex(s, d):
    return events(s, d).filter(T.name_matches("type", "/c[kt]/") | T.name_matches("type", "view")).select("id", "type")


@query(f"WITH {EV} SELECT e.id FROM ev e WHERE e.ptr IN (3, 5, 8) AND EXISTS (SELECT 1 FROM ev o WHERE o.type = 'error' AND o.stream = e.stream AND o.ptr = e.ptr)")
def trace_membership(s, d):
    e = events(s, d)
    wanted = e.filter("type = 'error'").select("stream", "ptr")
    return e.filter(F.col("ptr").isin(3, 5, 8)).join(wanted, ["stream", "ptr"], "left_semi").select("id")


@query(f"WITH {EV} SELECT e.id, e.stream FROM ev e WHERE NOT EXISTS (SELECT 1 FROM ev o WHERE o.type = 'error' AND o.stream = e.stream AND o.ptr = e.ptr)")
def trace_absent(s, d):
    e = events(s, d)
    return e.join(e.filter("type = 'error'").select("stream", "ptr"), ["stream", "ptr"], "left_anti").select("id", "stream")


@query(f"WITH {EV}, c AS (SELECT id, CASE WHEN type = 'error' THEN NULL ELSE size END AS counter FROM ev) SELECT id, counter FROM c WHERE counter IS NOT NULL")
def trace_not_null(s, d):
    return events(s, d).select("id", F.when(F.col("type") != "error", F.col("size")).alias("counter")).filter(F.col("counter").isNotNull())


@query(f"WITH {EV} SELECT type, time, size, ptr FROM ev")
def trace_column_range(s, d):
    return T.columns_from(events(s, d), "type")


@query(f"WITH {EV} SELECT id, size, NULL::BIGINT AS extra, 100 AS start_time FROM ev WHERE node = 0 UNION ALL SELECT id, size, ptr, 200 FROM ev WHERE node = 1")
def trace_merge_runs(s, d):
    e = events(s, d)
    return T.merge_runs({100: e.filter("node = 0").select("id", "size"), 200: e.filter("node = 1").select("id", "size", F.col("ptr").alias("extra"))}).select("id", "size", "extra", "start_time")


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY stream, type ORDER BY time, id) AS nth FROM ev) SELECT stream, type, id, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 2")
def trace_first_two(s, d):
    return T.occurrences(events(s, d), ["stream", "type"], 2).select("stream", "type", "id", "nth")


@query(f"WITH {EV} SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ev GROUP BY type")
def trace_message_sizes(s, d):
    return events(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {EV} SELECT node, bit_xor(id * 31 + size) AS checksum FROM ev GROUP BY node")
def trace_checksum(s, d):
    return events(s, d).groupBy("node").agg(F.bit_xor(F.col("id") * 31 + F.col("size")).alias("checksum"))


@query(f"WITH {EV}, l AS (SELECT node AS process, ptr AS unit, max_by(size, (time - 1704067200000000) * 100000 + id) AS y, max(time) AS x FROM ev GROUP BY node, ptr) SELECT process, CAST(sum(y) AS BIGINT) AS y, round(avg(x - 1704067200000000), 3) AS x FROM l GROUP BY process")
def trace_online_reduce(s, d):
    p = events(s, d).select(F.col("node").alias("process"), F.col("ptr").alias("unit"), "id", (F.col("time") - 1704067200000000).alias("x"), F.col("size").alias("y"))
    return T.latest_by_process(p).select("process", "y", F.round("x", 3).alias("x"))


@query(f"WITH {EV} SELECT stream, count(*) FILTER (WHERE (stream + ptr) % 7 = 0) AS steals, count(*) AS tasks FROM ev GROUP BY stream")
def trace_steals(s, d):
    return events(s, d).groupBy("stream").agg(F.count(F.when((F.col("stream") + F.col("ptr")) % 7 == 0, 1)).alias("steals"), F.count(F.lit(1)).alias("tasks"))


@query(f"""WITH {EV}, g AS (SELECT id, node, time, CASE type WHEN 'signup' THEN 1 WHEN 'click' THEN -1 ELSE 0 END AS pending, CASE WHEN type = 'click' THEN 1 ELSE 0 END AS retired, CASE WHEN type = 'signup' THEN 1 ELSE 0 END AS enabled,
CASE type WHEN 'view' THEN size ELSE 0 END AS allocated, CASE type WHEN 'view' THEN size WHEN 'purchase' THEN -size ELSE 0 END AS used FROM ev)
SELECT id, node, CAST(sum(pending) OVER w AS BIGINT) AS pending, CAST(sum(retired) OVER w AS BIGINT) AS retired, CAST(sum(enabled) OVER w AS BIGINT) AS enabled, CAST(sum(allocated) OVER w AS BIGINT) AS allocated, CAST(sum(used) OVER w AS BIGINT) AS used FROM g WINDOW w AS (PARTITION BY node ORDER BY time, id ROWS UNBOUNDED PRECEDING)""")
def trace_gauges(s, d):
    """Tasks pending, retired and enabled; memory allocated in all, and in use."""
    kind, size = F.col("type"), F.col("size")
    changes = {
        "pending": F.when(kind == "signup", 1).when(kind == "click", -1).otherwise(0), "retired": (kind == "click").cast("int"), "enabled": (kind == "signup").cast("int"),
        "allocated": F.when(kind == "view", size).otherwise(0), "used": F.when(kind == "view", size).when(kind == "purchase", -size).otherwise(0),
    }
    e = events(s, d).select("id", "node", "time", *(c.cast("long").alias(f"d_{n}") for n, c in changes.items()))
    return T.running_totals(e, ["node"], {n: f"d_{n}" for n in changes}, ["time", "id"], T.HOUR).select("id", "node", *changes)


@query(f"WITH {IV} SELECT node, CAST(sum(size) AS BIGINT) AS work, round(sum(size)::DOUBLE * 1000000 / (max(\"end\") - min(\"begin\")), 6) AS rate FROM iv GROUP BY node")
def trace_rate(s, d):
    return intervals(s, d).groupBy("node").agg(F.sum("size").alias("work"), F.round(F.sum("size").cast("double") * 1000000 / (F.max("end") - F.min("begin")), 6).alias("rate"))


@query(f'WITH {IV} SELECT \'task \' || CAST(ptr AS VARCHAR) AS name, \'X\' AS ph, round("begin" * 0.001, 3) AS ts, round(("end" - "begin") * 0.001, 3) AS dur, node AS pid, stream AS tid FROM iv WHERE ptr % 5 <> 0')
def trace_chrome_rows(s, d):
    from weftspark.sources.sinks import chrome_rows

    i = intervals(s, d).withColumn("name", F.concat(F.when(F.col("ptr") % 5 == 0, "RUNTIME ").otherwise("task "), F.col("ptr").cast("string")))
    return chrome_rows(i, skip=("RUNTIME ",))


@query(f"WITH {EV} SELECT type, max_by(id, size * 1000000 + id) AS best, max(size) AS priority FROM ev GROUP BY type")
def sort_best_by_priority(s, d):
    return events(s, d).groupBy("type").agg(F.max_by("id", F.col("size") * 1000000 + F.col("id")).alias("best"), F.max("size").alias("priority"))


@query(f"WITH {EV} SELECT id, size FROM ev ORDER BY size DESC, id LIMIT 20")
def sort_top_k(s, d):
    return events(s, d).orderBy(F.desc("size"), "id").limit(20).select("id", "size")


@query(f"WITH {EV} SELECT node, stream, time, id FROM ev ORDER BY node, stream, time")
def sort_multi_key(s, d):
    return events(s, d).select("node", "stream", "time", "id").orderBy("node", "stream", "time")


@query(f"WITH {IV} SELECT id, \"end\" - \"begin\" AS duration FROM iv ORDER BY 2, 1")
def sort_by_duration(s, d):
    return intervals(s, d).select("id", (F.col("end") - F.col("begin")).alias("duration")).orderBy("duration", "id")


@query(f"WITH {EV} SELECT id, size FROM ev ORDER BY size DESC, id DESC")
def sort_desc(s, d):
    return events(s, d).select("id", "size").orderBy(F.desc("size"), F.desc("id"))


@query(f"WITH {EV} SELECT id FROM ev WHERE type = 'purchase' AND node = 2 ORDER BY time, id LIMIT 1")
def sort_first_match(s, d):
    return events(s, d).filter("type = 'purchase' AND node = 2").orderBy("time", "id").limit(1).select("id")


@query(f"WITH {EV} SELECT type, node, count(*) AS runs, min(time) AS first FROM ev GROUP BY type, node")
def trace_partition_sets(s, d):
    return events(s, d).groupBy("type", "node").agg(F.count(F.lit(1)).alias("runs"), F.min("time").alias("first"))


@query(f"""WITH {EV}, l AS (SELECT id, stream, CASE WHEN stream % 3 = 0 THEN 'Thread ' || stream || ' of VP 0' WHEN stream % 3 = 1 THEN 'GPU ' || stream || '-1' ELSE 'MPI thread' END AS description FROM ev)
SELECT DISTINCT stream, CASE WHEN stream % 3 = 0 THEN 'cpu' WHEN stream % 3 = 1 THEN 'gpu' ELSE 'network' END AS class, CASE WHEN stream % 3 < 2 THEN CAST(stream AS INTEGER) END AS number FROM l""")
def trace_stream_classes(s, d):
    from weftspark.functions.scalars import stream_class, stream_number

    name = F.when(F.col("stream") % 3 == 0, F.format_string("Thread %d of VP 0", "stream")).when(F.col("stream") % 3 == 1, F.format_string("GPU %d-1", "stream")).otherwise("MPI thread")
    e = events(s, d).select("stream", name.alias("description")).distinct()
    return e.select("stream", stream_class(F.col("description")).alias("class"), stream_number(F.col("description")).alias("number"))


@query(f"WITH {EV} SELECT id, size & 255 AS flags, (size & 4) <> 0 AS counter, bit_count(size) AS bits, CAST((size * 2654435) % 16777216 // 65536 AS BIGINT) AS red FROM ev")
def function_bits(s, d):
    from weftspark.functions.scalars import has_flag, red_green_blue

    c = F.format_string("%06x", (F.col("size") * 2654435) % 16777216)
    return events(s, d).select("id", F.col("size").bitwiseAND(255).alias("flags"), has_flag(F.col("size"), 2).alias("counter"), F.bit_count("size").alias("bits"), red_green_blue(c)["red"].alias("red"))


@query(f"""WITH {EV}, r AS (SELECT *, ptr % 3 AS eid, id % 2 AS pool, type = 'view' AS s, type = 'purchase' AS e FROM ev),
n AS (SELECT *, coalesce(s AND lead(e) OVER w AND lead(eid) OVER w = eid AND lead(pool) OVER w = pool, false) AS direct, lead(time) OVER w AS nt, coalesce(lag(s) OVER w AND lag(eid) OVER w = eid AND lag(pool) OVER w = pool, false) AS taken FROM r WINDOW w AS (PARTITION BY stream ORDER BY time, id)),
c AS (SELECT * FROM n WHERE e AND NOT taken),
own AS (SELECT n.id, min(c.time) AS t FROM n JOIN c ON c.stream = n.stream AND c.eid = n.eid AND c.pool = n.pool AND (c.time > n.time OR (c.time = n.time AND c.id > n.id)) WHERE n.s GROUP BY n.id),
x AS (SELECT n.id, c.stream, min(c.time) AS t FROM n JOIN c ON c.node = n.node AND c.stream <> n.stream AND c.eid = n.eid AND c.pool = n.pool AND c.time >= n.time WHERE n.s GROUP BY n.id, c.stream),
o AS (SELECT id, min_by(t, stream) AS t FROM x GROUP BY id)
SELECT n.id, n.stream, n.time AS "begin", CASE WHEN direct THEN nt ELSE coalesce(own.t, o.t) END AS "end" FROM n LEFT JOIN own ON own.id = n.id LEFT JOIN o ON o.id = n.id WHERE n.s""")
def trace_match_events(s, d):
    """Starts and ends by type, event and taskpool: the next record, the thread, the node's other threads."""
    e = events(s, d).withColumns({"eid": F.col("ptr") % 3, "pool": F.col("id") % 2})
    return T.pair_intervals(e, ["node", "stream"], F.col("type") == "view", F.col("type") == "purchase", ("eid", "pool"), ["node"], width=T.width_for(e, ["node", "stream"])).select("id", "stream", "begin", "end")


@query(f"""WITH {EV}, {NB}, p AS (SELECT *, {STOP} FROM nb)
SELECT id, stream, time AS "begin", stop AS "end", CASE WHEN stop IS NULL THEN 'no matching end' WHEN stop - time > 36000000000 THEN 'unreasonable duration' END AS error FROM p WHERE type = 'view'""")
def trace_with_errors(s, d):
    e = events(s, d)
    p = T.interval_errors(T.pair_intervals(e, ["stream"], F.col("type") == "view", F.col("type") == "purchase", width=T.width_for(e, ["stream"])), 600 * MINUTE).select("id", "stream", "begin", "end", "error")
    return T.with_errors(p.filter("error IS NULL").drop("error"), p.filter("error IS NOT NULL"))


@query(f"WITH {EV} SELECT type, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) = 100 AND sum(size) = 12000 AS fine FROM ev WHERE type IN ('view', 'click') GROUP BY type")
def trace_check_messages(s, d):
    return T.check_messages(events(s, d), {"view": (100, 12000), "click": (100, 12000)}, size="size")


@query(f"WITH {EV} SELECT node, ptr % 7 AS cwd, count(*) AS n, array_to_string(list_sort(list(DISTINCT 'rank' || stream)), ' ') AS files FROM ev GROUP BY ALL")
def trace_group_runs(s, d):
    e = events(s, d).select("node", (F.col("ptr") % 7).alias("cwd"), F.concat(F.lit("rank"), F.col("stream").cast("string")).alias("file"))
    return T.group_runs(e, ("node", "cwd"), "file").withColumn("files", F.array_join("files", " "))


@query(f"WITH {EV} SELECT node, type, size, id FROM ev ORDER BY node DESC, size DESC, id DESC")
def sort_multi_key_desc(s, d):
    return events(s, d).select("node", "type", "size", "id").orderBy(F.desc("node"), F.desc("size"), F.desc("id"))


@query(f"""WITH {EV}, o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS pool, o_custkey % 4 AS node FROM orders)
SELECT e.id AS event, o.id AS task, o.node AS ran_on, e.node AS seen_on FROM ev e JOIN o ON e.id = o.id AND e.id % 3 = o.pool WHERE e.type = 'signup'""")
def trace_event_tasks(s, d):
    """The task that a network event speaks of, by taskpool and id."""
    tasks = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 3).alias("pool"), (F.col("o_custkey") % 4).alias("ran_on"))
    seen = events(s, d).filter("type = 'signup'").select(F.col("id").alias("event"), F.col("id").alias("task"), (F.col("id") % 3).alias("pool"), F.col("node").alias("seen_on"))
    return seen.join(tasks, ["pool", "task"]).select("event", "task", "ran_on", "seen_on")


@query(f"""WITH {EV}, o AS (SELECT o_orderkey AS id, o_custkey % 4 AS node FROM orders), l AS (SELECT DISTINCT l_orderkey AS src, l_orderkey + l_linenumber AS dst FROM lineitem)
SELECT e.id AS event, o.id AS task, l.dst AS successor FROM ev e JOIN o ON e.id = o.id JOIN l ON l.src = o.id JOIN o n ON n.id = l.dst WHERE e.type = 'signup' AND n.node = e.node""")
def trace_event_successors(s, d):
    """Of a network event's task, the successors that ran where the event was seen."""
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 4).alias("node"))
    edges = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("task"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("successor")).distinct()
    seen = events(s, d).filter("type = 'signup'").select(F.col("id").alias("event"), F.col("id").alias("task"), F.col("node"))
    after = seen.join(o.select("task"), "task").join(edges, "task")
    return after.join(o.withColumnRenamed("task", "successor"), ["successor", "node"]).select("event", "task", "successor")
