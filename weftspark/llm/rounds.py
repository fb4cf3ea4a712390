"""A round in which batches of rows ask others something and get the answers back.

``scatter`` turns a batch of rows into blobs for R ranges of keys and one to keep; each
range's blobs meet in ``reduce``, which answers the batches; ``gather`` gets a batch's kept
blob with all its answers, or asks again. Ranges are of hashed keys, and a batch names a key
once, so the ranges are even however common a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import batches, partitions, release, stable


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as one blob; small and sorted-then-differenced values take little room."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a.astype("<u8", copy=False))
        top = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :top].T)
        parts += [np.array([len(a), top], "<u8").tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def stretch(blob: bytes) -> list[np.ndarray]:
    """The arrays of a blob, as unsigned 64-bit integers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=1 << 31), np.uint8)
    out, at = [], 0
    while at < len(raw):
        n, top = (int(x) for x in raw[at : at + 16].view("<u8"))
        at += 16
        a = np.zeros((n, 8), np.uint8)
        a[:, :top] = raw[at : at + n * top].reshape(top, n).T
        at += n * top
        out.append(a.reshape(-1).view("<u8") if n else np.zeros(0, np.uint64))
    return out


def differences(a: np.ndarray) -> np.ndarray:
    """Of a sorted array; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def keep_rows(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def kept_rows(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


#: What a blob is: kept by its batch, for (or from) a range, or a batch's rows as they were read again.
KEPT, SENT, ROWS = 0, 1, 2
_SCHEMA = "r int, k long, kind int, data binary"


Scatter = Callable[[pa.RecordBatch, int], tuple[bytes, dict[int, bytes]]]
Reduce = Callable[[list[bytes]], list[bytes | None]]
Again = Callable[[bytes, list[bytes], int], tuple[bytes, dict[int, bytes]]]


_NAMES = ["r", "k", "kind", "data"]


def _columns(rows: list[tuple[int, int, int, bytes]]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)]


def ask(
    rows: DataFrame,
    column: str,
    scatter: Scatter,
    reduce: Reduce,
    gather: Callable[[bytes, list[bytes]], pa.Table],
    schema: str,
    most: int = 2 << 20,
    further: Sequence[tuple[Again, Reduce]] = (),
    keep: Callable[[pa.RecordBatch], bytes] | None = None,
) -> DataFrame:
    """A round over ``rows``, in batches of about ``most`` bytes of ``column``.

    In a further round a batch asks again, by what it kept and the answers that it got. What a
    batch keeps goes with the questions, unless ``keep`` gives it: then rows are read once
    more for each round, in the same batches, and what ``keep`` makes of them meets the
    answers with all that was kept along the way. ``rows`` are written first where reading them
    twice might give other batches; and a batch knows itself by a print, so none can be taken for another.
    """
    ranges = 4 * partitions(rows.sparkSession)
    if keep is not None:
        rows = stable(rows)

    # A task of a union has another number than the partition it reads, so the number comes with the rows.
    rows = rows.withColumn("_" * (1 + max(map(len, rows.columns))), F.spark_partition_id())

    def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for i, batch in enumerate(batches(source, column, most)):
            last = batch.num_columns - 1
            yield (batch.column(last)[0].as_py() << 24) + i, batch.remove_column(last)
            release()

    def out(k: int, kept: bytes, sent: dict[int, bytes]) -> list[tuple[int, int, int, bytes]]:
        return [(k % ranges, k, KEPT, kept), *((r, k, SENT, b) for r, b in sorted(sent.items()))]

    def send(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in numbered(source):
            for row in out(k, *scatter(batch, ranges)):
                yield pa.RecordBatch.from_arrays(_columns([row]), names=_NAMES)

    def own(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in numbered(source):
            yield pa.RecordBatch.from_arrays(_columns([(0, k, ROWS, keep(batch))]), names=_NAMES)

    def meeting(reduce: Reduce) -> Callable[[pa.Table], pa.Table]:
        def meet(group: pa.Table) -> pa.Table:
            order = np.argsort(group.column("k").to_numpy(), kind="stable")
            group = group.take(pa.array(order))
            kind, k, data = group.column("kind").to_numpy(), group.column("k").to_numpy(), group.column("data")
            sent = np.flatnonzero(kind == SENT)
            answers = reduce([data[int(i)].as_py() for i in sent])
            rows = [(0, int(k[i]), KEPT, data[int(i)].as_py()) for i in np.flatnonzero(kind == KEPT)]
            rows += [(0, int(k[i]), SENT, a) for i, a in zip(sent, answers, strict=True) if a is not None]
            release()
            return pa.table(_columns(rows), names=_NAMES)

        return meet

    def got(group: pa.Table) -> tuple[bytes, list[bytes]]:
        kind, data = group.column("kind").to_numpy(), group.column("data")
        rows, kept, sent = ([data[int(i)].as_py() for i in np.flatnonzero(kind == x)] for x in (ROWS, KEPT, SENT))
        if keep is None:
            return kept[0], sent
        if len(rows) != 1 or len(kept) != 1 or not kept[0].startswith(blake2b(rows[0], digest_size=16).digest()):
            raise ValueError("rows were read in other batches the second time")
        return kept[0][16:] + rows[0], sent

    def asking(again: Again) -> Callable[[tuple, pa.Table], pa.Table]:
        def ask_again(key: tuple, group: pa.Table) -> pa.Table:
            rows = out(key[0].as_py(), *again(*got(group), ranges))
            release()
            return pa.table(_columns(rows), names=_NAMES)

        return ask_again

    def gathered(group: pa.Table) -> pa.Table:
        table = gather(*got(group))
        release()
        return table

    def back(asked: DataFrame) -> DataFrame:
        return (asked if keep is None else asked.unionByName(rows.mapInArrow(own, _SCHEMA))).groupBy("k")

    asked = rows.mapInArrow(send, _SCHEMA).groupBy("r").applyInArrow(meeting(reduce), _SCHEMA)
    for again, then in further:
        asked = back(asked).applyInArrow(asking(again), _SCHEMA).groupBy("r").applyInArrow(meeting(then), _SCHEMA)
    return back(asked).applyInArrow(gathered, schema)


def known(kept: bytes, rows: bytes) -> bytes:
    """What a batch keeps along the way where its rows are read again: a print of them goes before it."""
    return blake2b(rows, digest_size=16).digest() + kept
