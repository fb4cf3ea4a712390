"""Helpers that the training-data operators share: reading, checkpoints, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The bytes that separate words in the word contracts.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Odd base of the polynomial word fingerprint, and the constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session makes."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, for what outlives a stage. Where none is named, a local session gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, with a short lineage and its true size."""
    path = f"{shared_folder(df.sparkSession)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back to the system what a worker no longer uses; allocators would keep it for the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def stable(df: DataFrame) -> DataFrame:
    """``df`` if it reads rows from files in the same order each time; else as a written table, which does."""
    nodes = [line.lstrip(" :+-").split(" ", 1)[0] for line in df._jdf.queryExecution().optimizedPlan().treeString().splitlines()]
    return df if all(n in ("Project", "Filter", "Relation") for n in nodes) else cut(df)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets from 0; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw, offsets - offsets[0]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word of the texts, and the n + 1 offsets of the texts' words.

    A word is a maximal run of bytes that ``between`` isn't true of (SPACE_BYTES, unless told
    otherwise); texts don't run into each other.
    """
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    np.logical_not(between[raw], out=inside[:n])
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    first[edges] = inside[edges]
    last = inside[:n] & ~inside[1:]
    inner = edges[edges > 0] - 1
    last[inner] = inside[inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes that are summed at once for word fingerprints.
STRETCH = 1 << 19


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit fingerprints of words, equal for equal bytes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _power(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        part = raw[a:b]
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * power[: b - a], out=total[1:])
        first, last = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        i = j
    return out


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of all runs of k neighbours in h (k - 1 fewer than h has)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h + np.uint64(seed)) * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:n] + np.uint64(k))


def span_hashes(h: np.ndarray, low: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What gram_hashes gives for the runs of these lengths from these places."""
    _, inverse = _power(len(h) + 1)
    power = _powers[0]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[low + length] - total[low]) * inverse[low] + length.astype(np.uint64))


def spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 3]: owners [0, 0, 2, 2, 2] and places within [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - begin[owner]


def batches(source: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts would hold more than ``most`` bytes together (single rows stay whole)."""
    for batch in source:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
