"""Binary traces: one file per process, each with a header, a dictionary of event types, threads and their events.

The driver reads what describes a file (header, information, dictionary, threads); events are
read by a data source with a partition for each thread. A type's number is the file's own, so
types are known by name, information format and length across files.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What a file begins with, how a number tells its byte order, the layouts of the
# header, of a buffer's head, a dictionary entry, a thread and a record, and a record's flag for information.
MAGIC = re.compile(rb"#[A-Z]+ BINARY PROFILE ")
ORDER = 0x0123456789ABCDEF
HEADER = struct.Struct("<q25s7xqi128si4xqi4xqiiq")
HEAD = struct.Struct("<qqqb")
ENTRY = struct.Struct("<64s128sii")
THREAD = struct.Struct("<qQ128sqi")
SIZES = struct.Struct("<ii")
RECORD = struct.Struct("<HHIQQ")
HAS_INFO = 1
EVENTS, DICTIONARY, THREADS, INFORMATION = 1, 2, 3, 4
#: Bytes that entries take beyond their text.
ENTRY_ROOM, THREAD_ROOM, INFO_ROOM = 203, 156, 11
#: The types of information fields as codes of the struct module.
FIELDS = {
    "int8_t": "b", "signed char": "b", "uint8_t": "B", "unsigned char": "B", "int16_t": "h", "short": "h", "uint16_t": "H", "unsigned short": "H",
    "int32_t": "i", "int": "i", "uint32_t": "I", "unsigned int": "I", "long": "l", "unsigned long": "L", "int64_t": "q", "long long": "q",
    "uint64_t": "Q", "unsigned long long": "Q", "float": "f", "double": "d",
}
#: Spark's types for those codes; unsigned ones need the next larger.
KINDS = {"b": "byte", "B": "short", "h": "short", "H": "int", "i": "int", "I": "long", "l": "long", "L": "decimal(20,0)", "q": "long", "Q": "decimal(20,0)", "f": "float", "d": "double", "s": "string"}

RAW = "node_id int, stream_id int, position long, name string, key int, is_end boolean, flags int, taskpool_id long, event_id decimal(20,0), timestamp long, info binary"


class BrokenTrace(ValueError):
    """Why a file is left out."""


@dataclass
class Stream:
    description: str
    first: int
    events: int
    info: dict[str, str] = field(default_factory=dict)


@dataclass
class Trace:
    """What a file says of itself. ``types`` are (name, attributes, format, length) by the file's own number."""

    path: str
    rank: int = -1
    run: str = ""
    size: int = 0
    error: str | None = None
    info: dict[str, str] = field(default_factory=dict)
    types: list[tuple[str, str, str, int]] = field(default_factory=list)
    streams: list[Stream] = field(default_factory=list)


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where.open_input_file(name)


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def _buffer(f, at: int, size: int, kind: int, what: str) -> tuple[int, int, bytes]:
    """(offset of the next buffer, number of entries, content) of a buffer of this kind."""
    if at < 0:
        raise BrokenTrace(f"broken {what}")
    f.seek(at)
    raw = f.read(size)
    if len(raw) < HEAD.size:
        raise BrokenTrace(f"broken {what}")
    _, after, count, found = HEAD.unpack_from(raw)
    if found != kind:
        raise BrokenTrace(f"broken {what}")
    return after, count, raw[HEAD.size :]


def _pairs(f, at: int, size: int, total: int) -> dict[str, str]:
    """Key and value texts; a value may run on into the next buffer."""
    out: dict[str, str] = {}
    if not total:
        return out
    after, count, raw = _buffer(f, at, size, INFORMATION, "information")
    place = here = 0
    while len(out) < total:
        if here == count:
            after, count, raw = _buffer(f, after, size, INFORMATION, "information")
            place = here = 0
        n, left = SIZES.unpack_from(raw, place)
        key, begin = raw[place + 8 : place + 8 + n], place + 8 + n
        place += INFO_ROOM + n
        value = b""
        while left:
            part = min(size - HEAD.size - place, left)
            value += raw[begin : begin + part]
            place, left = place + part, left - part
            if place >= size - HEAD.size and left:
                after, count, raw = _buffer(f, after, size, INFORMATION, "information")
                place = begin = here = 0
        out[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        here += 1
    return out


def read_header(path: str) -> Trace:
    """What a file says of itself, or why it can't be read."""
    out = Trace(path)
    try:
        with _open(path) as f:
            raw = f.read(HEADER.size)
            if len(raw) < HEADER.size:
                raise BrokenTrace("too small")
            _, magic, order, out.size, run, types, types_at, infos, infos_at, out.rank, threads, threads_at = HEADER.unpack(raw)
            if not MAGIC.match(magic):
                raise BrokenTrace("no magic")
            if order != ORDER:
                raise BrokenTrace("wrong byte order")
            out.run = _text(run)
            out.info = _pairs(f, infos_at, out.size, infos)
            after, here, place, raw = types_at, 0, 0, b""
            while len(out.types) < types:
                if not here:
                    after, here, raw = _buffer(f, after, out.size, DICTIONARY, "dictionary")
                    place = 0
                name, attributes, n, length = ENTRY.unpack_from(raw, place)
                form = raw[place + ENTRY.size : place + ENTRY.size + n]
                out.types.append((_text(name), _text(attributes)[-6:], _text(form), length))
                place, here = place + ENTRY_ROOM + n, here - 1
            after, here = threads_at, 0
            while len(out.streams) < threads:
                if not here:
                    after, here, raw = _buffer(f, after, out.size, THREADS, "threads")
                    place = 0
                _, count, description, first, infos = THREAD.unpack_from(raw, place)
                place += THREAD_ROOM
                stream = Stream(_text(description), first, count)
                for _ in range(infos):
                    n, m = SIZES.unpack_from(raw, place)
                    stream.info[raw[place + 8 : place + 8 + n].decode()] = raw[place + 8 + n : place + 8 + n + m].decode()
                    place += INFO_ROOM + n + m
                out.streams.append(stream)
                here -= 1
    except OSError:
        out.error = "unable to open"
    except (BrokenTrace, struct.error) as e:
        out.error = str(e) if isinstance(e, BrokenTrace) else "broken"
    return out


def open_traces(paths: list[str]) -> list[Trace]:
    """The files of one run; those that are not of the first good one's run, or of other buffers, have an error too."""
    out = [read_header(p) for p in paths]
    first = next((t for t in out if t.error is None), None)
    for t in out:
        if first and t.error is None and t.run != first.run:
            t.error = "different run"
        elif first and t.error is None and t.size != first.size:
            t.error = "different buffers"
    return out


class _Part(InputPartition):
    def __init__(self, trace: Trace, stream: int) -> None:
        self.trace, self.stream = trace, stream


def records(trace: Trace, stream: int, most: int = 8192) -> Iterator[pa.RecordBatch]:
    """A thread's records in the order of the file."""
    rows: list[tuple] = []
    at, position, left = trace.streams[stream].first, 0, trace.streams[stream].events
    schema = pa.schema([("node_id", pa.int32()), ("stream_id", pa.int32()), ("position", pa.int64()), ("name", pa.string()), ("key", pa.int32()), ("is_end", pa.bool_()), ("flags", pa.int32()), ("taskpool_id", pa.int64()), ("event_id", pa.decimal128(20, 0)), ("timestamp", pa.int64()), ("info", pa.binary())])

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    with _open(trace.path) as f:
        while at >= 0 and left:
            at, count, raw = _buffer(f, at, trace.size, EVENTS, "events")
            place = 0
            for _ in range(count):
                key, flags, pool, event, time = RECORD.unpack_from(raw, place)
                place += RECORD.size
                kind = trace.types[key >> 1] if key >> 1 < len(trace.types) else None
                info = None
                if flags & HAS_INFO and kind:
                    info = raw[place : place + kind[3]]
                    place += kind[3]
                rows.append((trace.rank, stream, position, kind and kind[0], key >> 1, bool(key & 1), flags, pool, Decimal(event), time, info))
                position += 1
                if len(rows) == most:
                    yield batch()
                    rows.clear()
    if rows:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.traces = [t for t in open_traces(paths) if t.error is None]

    def partitions(self) -> list[InputPartition]:
        return [_Part(t, k) for t in self.traces for k in range(len(t.streams))] or [_Part(None, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.trace is not None:
            yield from records(partition.trace, partition.stream)


class TraceSource(DataSource):
    """spark.read.format("trace").option("paths", "a,b").load() gives raw records, a partition for each thread."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split(","))


def raw_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the files that can be read; ``name`` is null where a file's dictionary has no such type."""
    spark.dataSource.register(TraceSource)
    return spark.read.format("trace").option("paths", ",".join(paths)).load()


def described(spark: SparkSession, traces: list[Trace]) -> dict[str, DataFrame]:
    """The small tables: nodes, streams, event_types, and information as (node, key, value). Their size is that of the headers."""
    good = [t for t in traces if t.error is None]
    types = list(dict.fromkeys(x for t in good for x in t.types))
    nodes = [(t.rank, t.run, t.path, t.error) for t in traces]
    streams = [(t.rank, k, x.description, x.events) for t in good for k, x in enumerate(t.streams)]
    info = [(t.rank, k, v) for t in good for k, v in t.info.items()]
    return {
        "nodes": spark.createDataFrame(nodes, "id int, exe string, filename string, error string"),
        "streams": spark.createDataFrame(streams, "node_id int, stream_id int, description string, events long"),
        "event_types": spark.createDataFrame([(k, *x) for k, x in enumerate(types)], "type int, name string, attributes string, convertor string, length int"),
        "information": spark.createDataFrame(info, "node int, key string, value string"),
    }


def trace_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Everything the files say of themselves, a row each: file, rank, key, value."""
    rows = [(t.path, t.rank, k, v) for t in open_traces(paths) for k, v in {"error": t.error or "none", "exe": t.run, "threads": str(len(t.streams)), **t.info}.items()]
    return spark.createDataFrame(rows, "file string, rank int, key string, value string")


def layout(convertor: str, length: int) -> tuple[list[str], str]:
    """Names and struct format of an information blob ``name{type};name{type}``; fields of unknown types are left out."""
    names, code = [], "@"
    for part in filter(None, convertor.split(";")):
        name, _, kind = part.partition("{")
        kind = kind.replace("}", "")
        text = re.fullmatch(r"char\[(\d+)\]", kind)
        if name and (kind in FIELDS or text):
            names.append(name.replace(" ", "_"))
            code += f"{text[1]}s" if text else FIELDS[kind]
    if struct.calcsize(code) > length:
        raise ValueError(f"{convertor} takes more than {length} bytes")
    return names, f"{code}{length - struct.calcsize(code)}x"


def decoded(raw: DataFrame, convertor: str, length: int) -> DataFrame:
    """``raw`` with the fields of its blobs as columns in place of ``info``; names that begin with ## are left out.

    A text ends at its first NUL. Records without information, or with too little, have nulls.
    """
    names, form = layout(convertor, length)
    codes = re.findall(r"\d*([a-zA-Z])", form)[: len(names)]
    kept = [(k, n, c) for k, (n, c) in enumerate(zip(names, codes, strict=True)) if not n.startswith("##")]
    own = [c for c in raw.columns if c != "info"]
    at = raw.columns.index("info")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema if f.name != "info"), *(f"`{n}` {KINDS[c]}" for _, n, c in kept)])
    arrow = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = struct.Struct(form)
        for b in source:
            values = [how.unpack(x) if x is not None and len(x) == how.size else None for x in b.column(at).to_pylist()]
            columns = [b.column(i) for i in range(b.num_columns) if i != at]
            for k, _, c in kept:
                cell = [None if v is None else _text(v[k]) if c == "s" else Decimal(v[k]) if KINDS[c].startswith("decimal") else v[k] for v in values]
                columns.append(pa.array(cell, arrow[KINDS[c]]))
            yield pa.RecordBatch.from_arrays(columns, names=[*own, *(n for _, n, _ in kept)])

    return raw.mapInArrow(run, schema)


def event_info(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """The records of one type with their information as columns, whatever number a file gives the type."""
    found = next((x for t in open_traces(paths) if t.error is None for x in t.types if x[0] == name), None)
    if found is None:
        raise ValueError(f"no event type {name}")
    return decoded(raw_events(spark, paths).filter(F.col("name") == name), found[2], found[3])


def read_tables(spark: SparkSession, paths: list[str], skeleton: bool = False) -> dict[str, DataFrame]:
    """nodes, streams, event_types and information; and, unless a skeleton will do, events and errors."""
    from weftspark.operators.trace import build_events

    out = described(spark, open_traces(paths))
    if not skeleton:
        raw = raw_events(spark, paths).withColumnRenamed("name", "type")
        out["events"], out["errors"] = build_events(raw, F.col("type").isNotNull())
    return out


def save_tables(tables: dict[str, DataFrame], path: str, compression: str = "zstd", overwrite: bool = True) -> None:
    """A folder for each table. Spark's committer shows a table only when it is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(f"{path.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, path: str, skeleton: bool = False) -> dict[str, DataFrame]:
    """What save_tables wrote; a skeleton leaves out events and errors, which are never read then."""
    small = ("nodes", "streams", "event_types", "information")
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in (small if skeleton else (*small, "events", "errors"))}


def convert(spark: SparkSession, paths: list[str], out: str, compression: str = "zstd") -> None:
    """Binary traces into a folder of tables."""
    save_tables(read_tables(spark, paths), out, compression)
