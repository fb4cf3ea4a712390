"""Binary traces written by hand, and what is read from them."""

import struct

import pytest
from pyspark.sql import functions as F

from weftspark.operators import trace as T
from weftspark.sources import traces

SIZE = 4096
TYPES = [("TASK", "fill:#ff0000", "a{int32_t};##x{int32_t};who{char[8]};big{uint64_t}", 24), ("MEM", "fill:#00ff00", "", 0)]
# (key, flags, pool, event, time, info): a normal pair; a nested pair; an end that directly follows its start, which another
# start can't have; two starts that share one end; a start without end; an end without start; an unknown type; time going back; a pair on two threads.
INFO = struct.pack("@ii8sQ", 7, 9, b"abc", 2**63 + 5)
MAIN = [
    (0, 1, 1, 1, 10, INFO), (2, 0, 1, 5, 12, b""), (3, 0, 1, 5, 14, b""), (1, 0, 1, 1, 20, b""),
    (0, 0, 1, 2, 30, b""), (0, 0, 1, 2, 31, b""), (1, 0, 1, 2, 32, b""),
    (0, 0, 1, 3, 40, b""), (0, 0, 1, 3, 41, b""), (2, 0, 1, 6, 42, b""), (1, 0, 1, 3, 43, b""),
    (1, 0, 1, 99, 45, b""), (18, 0, 1, 1, 46, b""), (2, 0, 1, 7, 44, b""), (0, 0, 1, 8, 50, b""),
]
OTHER = [(1, 0, 1, 8, 60, b"")]


def buffer(at, after, count, kind, content):
    raw = struct.pack("<qqqb", at, after, count, kind) + content
    assert len(raw) <= SIZE
    return raw + bytes(SIZE - len(raw))


def info(key, value):
    return struct.pack("<ii", len(key), len(value)) + key + value + bytes(3)


def write(path, rank=0, run=b"run", order=0x0123456789ABCDEF, magic=b"#TEST BINARY PROFILE ", types=TYPES, threads=(MAIN, OTHER), long=b"v" * 6000):
    blocks = {}
    at = SIZE
    names = b"".join(struct.pack("<64s128sii", n.encode(), a.encode(), len(c), k) + c.encode() + bytes(3) for n, a, c, k in types)
    blocks[at] = buffer(at, -1, len(types), 2, names)
    types_at, at = at, at + SIZE
    room = SIZE - 25
    head = info(b"exe", b"prog") + struct.pack("<ii", 4, len(long)) + b"long"
    # The value's first part is as long as what the reader takes to be left in the buffer.
    first = room - (len(info(b"exe", b"prog")) + 11 + 4)
    blocks[at] = buffer(at, at + SIZE, 2, 4, (head + long[:first])[:room])
    blocks[at + SIZE] = buffer(at + SIZE, -1, 0, 4, long[first:])
    infos_at, at = at, at + 2 * SIZE
    streams = b""
    threads_at, at = at, at + SIZE
    for k, rows in enumerate(threads):
        split = (rows[: len(rows) // 2], rows[len(rows) // 2 :]) if len(rows) > 1 else (rows,)
        streams += struct.pack("<qQ128sqi", -1, len(rows), f"Thread {k} of VP 0".encode(), at, 1) + info(b"k", b"v")
        for j, part in enumerate(split):
            last = j == len(split) - 1
            blocks[at] = buffer(at, -1 if last else at + SIZE, len(part), 1, b"".join(struct.pack("<HHIQQ", *r[:5]) + r[5] for r in part))
            at += SIZE
    blocks[threads_at] = buffer(threads_at, -1, len(threads), 3, streams)
    header = struct.pack("<q25s7xqi128si4xqi4xqiiq", 0, magic, order, SIZE, run, len(types), types_at, 2, infos_at, rank, len(threads), threads_at)
    with open(path, "wb") as f:
        f.write(header + bytes(SIZE - len(header)))
        for a in sorted(blocks):
            f.seek(a)
            f.write(blocks[a])
    return str(path)


def test_records_and_descriptions(spark, tmp_path):
    a = write(tmp_path / "a")
    b = write(tmp_path / "b", rank=1, types=TYPES[::-1], threads=([(2, 1, 1, 1, 5, INFO), (3, 0, 1, 1, 6, b"")],))
    raw = traces.raw_events(spark, [a, b]).orderBy("node_id", "stream_id", "position").collect()
    assert [(r.node_id, r.stream_id, r.position) for r in raw] == [(0, 0, i) for i in range(len(MAIN))] + [(0, 1, 0), (1, 0, 0), (1, 0, 1)]
    assert [r.name for r in raw[:2]] == ["TASK", "MEM"] and raw[12].name is None and raw[-1].name == "TASK"
    small = traces.described(spark, traces.open_traces([a, b]))
    assert {(r.name, r.attributes, r.length) for r in small["event_types"].collect()} == {("TASK", "ff0000", 24), ("MEM", "00ff00", 0)}
    assert [r.value for r in small["information"].filter("key = 'long' AND node = 0").collect()] == ["v" * 6000]
    assert {r.description for r in small["streams"].collect()} == {"Thread 0 of VP 0", "Thread 1 of VP 0"}
    said = {(r.rank, r.key): r.value for r in traces.trace_info(spark, [a]).collect()}
    assert said[0, "exe"] == "prog" and said[0, "threads"] == "2"
    info = {(r.node_id, r.stream_id, r.position): r for r in traces.event_info(spark, [a, b], "TASK").collect()}
    assert "_x" not in info[0, 0, 0].asDict() and not any(c.startswith("##") for c in info[0, 0, 0].asDict())
    assert (info[0, 0, 0].a, info[0, 0, 0].who, int(info[0, 0, 0].big)) == (7, "abc", 2**63 + 5) == (info[1, 0, 0].a, info[1, 0, 0].who, int(info[1, 0, 0].big))
    assert info[0, 0, 3].a is None


def test_files_that_cannot_be_read(tmp_path):
    (tmp_path / "small").write_bytes(b"x" * 50)
    paths = [str(tmp_path / "none"), str(tmp_path / "small"), write(tmp_path / "m", magic=b"#OTHER"), write(tmp_path / "o", order=1), write(tmp_path / "ok"), write(tmp_path / "run", run=b"another")]
    assert [t.error for t in traces.open_traces(paths)] == ["unable to open", "too small", "no magic", "wrong byte order", None, "different run"]


def test_events_and_errors(spark, tmp_path):
    tables = traces.read_tables(spark, [write(tmp_path / "a")])
    events = sorted((r.begin, r.end, r.type, int(r.id)) for r in tables["events"].collect())
    assert events == [(10, 20, "TASK", 1), (12, 14, "MEM", 5), (31, 32, "TASK", 2), (40, 43, "TASK", 3), (41, 43, "TASK", 3), (50, 60, "TASK", 8)]
    errors = sorted((r.begin, r.error_msg) for r in tables["errors"].collect())
    assert errors == [(30, "no matching end"), (42, "no matching end"), (44, "before its predecessor"), (46, "unknown type")]
    assert T.with_errors(tables["events"], tables["errors"]).count() == 10
    raw = traces.raw_events(spark, [str(tmp_path / "a")]).withColumnRenamed("name", "type")
    long = T.build_events(raw, F.col("type").isNotNull(), F.lit(8))[1]
    assert {r.begin for r in long.filter("error_msg = 'unreasonable duration'").collect()} == {10, 50}


def test_tables_are_saved_and_loaded(spark, tmp_path):
    a = write(tmp_path / "a")
    traces.convert(spark, [a], str(tmp_path / "out"))
    back = traces.load_tables(spark, str(tmp_path / "out"))
    assert back["events"].count() == 6 and back["nodes"].first().filename == a
    assert set(traces.load_tables(spark, str(tmp_path / "out"), skeleton=True)) == {"nodes", "streams", "event_types", "information"}
    assert "events" not in traces.read_tables(spark, [a], skeleton=True)


def test_messages_and_async_tasks_of_golden_runs(spark):
    wanted = {"MPI_ACTIVATE": (100, 12000), "MPI_DATA_CTL": (100, 209715200), "MPI_DATA_PLD_SND": (100, 209715200), "MPI_DATA_PLD_RCV": (100, 209715200)}
    rows = [(t, w[1] // 100) for t, w in wanted.items() for _ in range(100)]
    assert {r.type: r.fine for r in T.check_messages(spark.createDataFrame(rows, "type string, msg_size long"), wanted).collect()} == dict.fromkeys(wanted, True)
    short = T.check_messages(spark.createDataFrame(rows[1:], "type string, msg_size long"), wanted)
    assert {r.type: r.fine for r in short.collect()}["MPI_ACTIVATE"] is False
    # Two short tasks touch each long one: the first ends in it, the second begins in it.
    n = 20
    full = spark.createDataFrame([(k, 0, 100 * k + 10, 100 * k + 60) for k in range(n)], "id long, node long, begin long, end long")
    half = spark.createDataFrame([(n + 2 * k + h, 0, 100 * k + (5, 50)[h], 100 * k + (20, 70)[h]) for k in range(n) for h in (0, 1)], "id long, node long, begin long, end long")
    begun = T.contained(half, full, ["node"], 1000)
    assert begun.count() == n and begun.filter("whole").count() == 0
    ended = T.contained(half.select("id", "node", F.col("end").alias("begin"), "end"), full, ["node"], 1000)
    assert ended.filter("whole").count() == n and T.overlap_pairs(half, ["node"], 1000).count() == 0


def test_a_missing_type_and_too_long_a_format(spark, tmp_path):
    with pytest.raises(ValueError, match="no event type"):
        traces.event_info(spark, [write(tmp_path / "a")], "NONE")
    with pytest.raises(ValueError, match="more than 4 bytes"):
        traces.layout("a{int64_t}", 4)
