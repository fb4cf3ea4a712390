"""Sinks for traces and graphs: Chrome JSON, XML, Paje, DOT; and the DOT source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chrome_rows(intervals: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Complete events (ph X) with times in milliseconds; names that begin with one of ``skip`` are left out."""
    kept = intervals
    for prefix in skip:
        kept = kept.filter(~F.col("name").startswith(prefix))
    ms = lambda c: F.round(c * 0.001, 3)
    return kept.select("name", F.lit("X").alias("ph"), ms(F.col("begin")).alias("ts"), ms(F.col("end") - F.col("begin")).alias("dur"), F.col("node").alias("pid"), F.col("stream").alias("tid"))


def write_chrome(intervals: DataFrame, path: str, skip: tuple[str, ...] = ()) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    chrome_rows(intervals, skip).write.mode("overwrite").json(path)


def write_xml(intervals: DataFrame, path: str, width: int = 3_600_000_000) -> None:
    """Rows of a stream with its events nested in time order; a stream has a row for each ``part`` of time, so none grows without bound."""
    event = F.struct("begin", "end", "name", "id")
    parts = intervals.withColumn("part", F.floor(F.col("begin") / F.lit(width)))
    streams = parts.groupBy("node", "stream", "part").agg(F.array_sort(F.collect_list(event)).alias("event"))
    streams.write.mode("overwrite").option("rowTag", "thread").option("rootTag", "profile").format("xml").save(path)


#: The events of a Paje file, their numbers and fields, and its types of containers, states, variables and links.
PAJE = """%EventDef PajeDefineContainerType 0
% Alias string
% Type string
% Name string
%EndEventDef
%EventDef PajeDefineStateType 1
% Alias string
% Type string
% Name string
%EndEventDef
%EventDef PajeDefineVariableType 2
% Alias string
% Type string
% Name string
%EndEventDef
%EventDef PajeDefineLinkType 3
% Alias string
% Type string
% StartContainerType string
% EndContainerType string
% Name string
%EndEventDef
%EventDef PajeCreateContainer 4
% Time date
% Alias string
% Type string
% Container string
% Name string
%EndEventDef
%EventDef PajeSetState 5
% Time date
% Type string
% Container string
% Value string
%EndEventDef
%EventDef PajeAddVariable 6
% Time date
% Type string
% Container string
% Value double
%EndEventDef
%EventDef PajeStartLink 7
% Time date
% Type string
% Container string
% StartContainer string
% Value string
% Key string
%EndEventDef
%EventDef PajeEndLink 8
% Time date
% Type string
% Container string
% EndContainer string
% Value string
% Key string
%EndEventDef
0 CT_Appli 0 "Application"
0 CT_P CT_Appli "Process"
0 CT_T CT_P "Thread"
1 ST_T CT_T "State"
2 V_P CT_P "Counter"
3 L_C CT_Appli CT_T CT_T "Communication"
4 0.0 C_Appli CT_Appli 0 "Application"
""".splitlines()


def paje_lines(intervals: DataFrame, counters: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(part, t, value): the lines of a Paje file. The definitions are part 0, containers part 1, what happens part 2.

    Intervals (node, stream, begin, end, name) set a thread's state and then 'Waiting' again;
    counters (node, time, change) add to a process' variable; links (from_node, from_stream,
    begin, to_node, to_stream, end, key) join threads.
    """
    spark = intervals.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.posexplode(F.array(*map(F.lit, PAJE))).alias("t", "value")).withColumn("t", F.col("t").cast("long"))
    at = lambda part, t, text, *c: (F.lit(part).alias("part"), t.cast("long").alias("t"), F.format_string(text, *c).alias("value"))
    zero = F.lit(0)
    nodes = intervals.select("node").distinct().select(*at(1, zero, '4 0.0 P%d CT_P C_Appli "Process %d"', "node", "node"))
    threads = intervals.select("node", "stream").distinct().select(*at(1, zero + 1, '4 0.0 P%dT%d CT_T P%d "Thread %d"', "node", "stream", "node", "stream"))
    begun = intervals.select(*at(2, F.col("begin"), '5 %d ST_T P%dT%d "%s"', "begin", "node", "stream", "name"))
    ended = intervals.select(*at(2, F.col("end"), '5 %d ST_T P%dT%d "Waiting"', "end", "node", "stream"))
    out = [head, nodes, threads, begun, ended]
    if counters is not None:
        out.append(counters.select(*at(2, F.col("time"), "6 %d V_P P%d %s", "time", "node", F.col("change").cast("string"))))
    if links is not None:
        key = F.col("key").cast("string")
        out.append(links.select(*at(2, F.col("begin"), '7 %d L_C C_Appli P%dT%d "" "%s"', "begin", "from_node", "from_stream", key)))
        out.append(links.select(*at(2, F.col("end"), '8 %d L_C C_Appli P%dT%d "" "%s"', "end", "to_node", "to_stream", key)))
    return reduce(DataFrame.unionByName, out)


def write_paje(intervals: DataFrame, path: str, counters: DataFrame | None = None, links: DataFrame | None = None) -> None:
    """A Paje file in parts, sorted over all of them: definitions, containers, then what happens in time order."""
    paje_lines(intervals, counters, links).orderBy("part", "t", "value").select("value").write.mode("overwrite").text(path)


def write_dot(tasks: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph in parts: its first line, node lines, edge lines, its last line.

    Tasks have name, thid, vpid, label, param, local, prio, tpid, tcid, tcname and tid; edges
    src, dst, flow_src, flow_dst, color and style. Plain tasks (id, label) and edges (src, dst, flow) do too.
    """
    spark = tasks.sparkSession
    if "tcid" in tasks.columns:
        text = '%s [shape="polygon",label="<%d/%d> %s(%s)%s<%d>{%d}",tooltip="tpid=%d:tcid=%d:tcname=%s:tid=%d"];'
        nodes = tasks.select(F.lit(1).alias("part"), F.format_string(text, "name", "thid", "vpid", "label", "param", "local", "prio", "tpid", "tpid", "tcid", "tcname", "tid").alias("value"))
        links = edges.select(F.lit(2).alias("part"), F.format_string('%s -> %s [label="%s=>%s",color="%s",style="%s"];', "src", "dst", "flow_src", "flow_dst", "color", "style").alias("value"))
    else:
        nodes = tasks.select(F.lit(1).alias("part"), F.format_string('"%s" [label="%s"];', "id", "label").alias("value"))
        links = edges.select(F.lit(2).alias("part"), F.format_string('"%s" -> "%s" [label="%s"];', "src", "dst", "flow").alias("value"))
    frame = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("digraph G {").alias("value")), F.struct(F.lit(3).alias("part"), F.lit("}").alias("value")))).alias("x")).select("x.*")
    frame.unionByName(nodes).unionByName(links).orderBy("part", "value").select("value").write.mode("overwrite").text(path)


def read_dot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges) of a DOT text of plain nodes and links; other lines are passed over."""
    lines = spark.read.text(path)
    link = r'^\s*"?([^"\s\[]+)"?\s*->\s*"?([^"\s\[;]+)"?\s*(?:\[.*?label="([^"]*)".*\])?'
    node = r'^\s*"?([^"\s\[]+)"?\s*\[.*?label="([^"]*)".*\]'
    edges = lines.filter(F.col("value").rlike(link)).select(*(F.regexp_extract("value", link, i).alias(c) for i, c in ((1, "src"), (2, "dst"), (3, "flow"))))
    tasks = lines.filter(F.col("value").rlike(node) & ~F.col("value").rlike(link)).select(*(F.regexp_extract("value", node, i).alias(c) for i, c in ((1, "id"), (2, "label"))))
    return tasks, edges


#: What a task line of a dumped graph holds, in order, and a link line; whole numbers are read as such.
TASK_LINE = r'^\s*(\S+) .*label="<(\d+)/(\d+)>[^a-zA-Z_]*([^(]+)\(([^)]*)\)([^<]*)<(\d+)>[^{]*\{(\d+)\}.*tpid=(\d+).*tcid=(\d+).*tcname=([^:]+).*tid=(\d+)'
TASK_FIELDS = "name thid vpid label param local prio tpid tt_tpid tt_tcid tt_tcname tt_tid".split()
LINK_LINE = r'^\s*(\S+)\s*->\s*(\S+) .*label="([^=]+)=>([^,"]+)".*color="([^"]+)".*style="([^"]+)"'
LINK_FIELDS = "src dst flow_src flow_dst color style".split()
WHOLE = frozenset("thid vpid prio tpid tt_tpid tt_tcid tt_tid".split())


def read_task_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, edges) of a graph that a run dumped. A line that is none of its kinds, or a task of two taskpools, is an error when read."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(digraph G \{|\})?\s*$"))
    task, link = F.col("value").rlike(TASK_LINE), F.col("value").rlike(LINK_LINE)
    known = lines.filter(task | link | F.raise_error(F.concat(F.lit("neither a task nor a link: "), F.col("value"))).cast("boolean"))
    pull = lambda line, names: [F.regexp_extract("value", line, k + 1).cast("long" if n in WHOLE else "string").alias(n) for k, n in enumerate(names)]
    tasks = known.filter(task).select(*pull(TASK_LINE, TASK_FIELDS))
    tasks = tasks.filter((F.col("tpid") == F.col("tt_tpid")) | F.raise_error(F.concat(F.lit("two taskpools: "), F.col("name"))).cast("boolean"))
    return tasks, known.filter(~task & link).select(*pull(LINK_LINE, LINK_FIELDS))


def write_tiles(cells: DataFrame, path: str, owner: str = "owner") -> None:
    """A matrix as Parquet, a folder for each owner."""
    cells.write.mode("overwrite").partitionBy(owner).parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
