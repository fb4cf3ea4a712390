"""Opaque operators: Python functions over whole tiles, over pairs of tiles, over tasks, and as reductions.

A tile is a row (m, n, tile) whose cells (i, j, v) are gathered into one array; its size is
bounded by mb x nb, so a tile fits a task whatever the matrix. Functions see numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.tiles import FULL, region, with_tiles

Tile = np.ndarray
#: Cells that a task makes anew at once.
CELLS = 1 << 18


def to_tiles(cells: DataFrame, mb: int, nb: int) -> DataFrame:
    """(m, n, tile): the cells of each tile, by place."""
    place = F.struct((F.col("i") % mb).cast("int").alias("a"), (F.col("j") % nb).cast("int").alias("b"), "v")
    return with_tiles(cells, mb, nb).groupBy("m", "n").agg(F.array_sort(F.collect_list(place)).alias("tile"))


def from_tiles(tiles: DataFrame, mb: int, nb: int) -> DataFrame:
    """The cells of tiles."""
    c = tiles.select("m", "n", F.explode("tile").alias("x"))
    return c.select((F.col("m") * mb + F.col("x.a")).alias("i"), (F.col("n") * nb + F.col("x.b")).alias("j"), F.col("x.v").alias("v"))


def _arrays(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    flat, offsets = column.flatten(), column.offsets.to_numpy()
    a, b, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "v"))
    first = offsets[0]
    for x, y in zip(offsets[:-1] - first, offsets[1:] - first, strict=True):
        yield a[x:y], b[x:y], v[x:y]


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` cells, or of a tile."""
    offsets, k = batch.column(column).offsets.to_numpy(), 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop


def map_tiles(tiles: DataFrame, op: Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str = FULL, most: int = CELLS) -> DataFrame:
    """op(m, n, rows, columns, values) of each tile gives its new values.

    With a triangle, tiles beyond the diagonal are left as they are and a tile on it gets
    only its part of the triangle (the diagonal included) changed. ``most`` cells (a tile at
    least) are made anew at once, however many tiles come in a batch.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in source for p in _parts(batch, 2, most)):
            column, out = part.column(2), []
            flat, offsets = column.flatten(), column.offsets.to_numpy()
            for m, n, (a, b, v) in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _arrays(column), strict=True):
                inside = kind == FULL or (m > n if kind == "lower" else m < n)
                if inside or m == n:
                    new = np.asarray(op(m, n, a, b, v))
                    v = new if inside else np.where(a >= b if kind == "lower" else a <= b, new, v)
                if v.shape != a.shape:
                    raise ValueError(f"the operator gave {v.shape} values for the {len(a)} cells of tile ({m}, {n})")
                out.append(pa.array(v.tolist(), flat.type.field("v").type))
            cells = pa.StructArray.from_arrays([flat.field("a"), flat.field("b"), pa.concat_arrays(out)], fields=list(flat.type))
            tile = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), cells, type=column.type)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tile], names=["m", "n", "tile"])

    region(kind)  # refuses what is no region
    return tiles.select("m", "n", "tile").mapInArrow(run, tiles.select("m", "n", "tile").schema)


def reduce_opaque(cells: DataFrame, mb: int, nb: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Element-wise reduction of all tiles by an associative and commutative function of two arrays: (a, b, v).

    Each task reduces its own rows first, so at most a tile for each partition is exchanged.
    """
    t = cells.select((F.col("i") % mb).alias("a"), (F.col("j") % nb).alias("b"), "v")
    kind = t.schema["v"].dataType.simpleString()

    def fold(parts: Iterator[pa.Table | pa.RecordBatch]) -> dict[tuple[int, int], object]:
        total: dict[tuple[int, int], object] = {}
        for part in parts:
            for key, v in zip(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True), part.column("v").to_pylist(), strict=True):
                total[key] = v if key not in total else op(np.asarray(total[key]), np.asarray(v)).item()
        return total

    def columns(total: dict) -> dict:
        return {"a": pa.array([k[0] for k in total], pa.int64()), "b": pa.array([k[1] for k in total], pa.int64()), "v": pa.array(list(total.values()))}

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = fold(source)
        if total:
            yield pa.RecordBatch.from_pydict(columns(total))

    schema = f"a long, b long, v {kind}"
    some = t.mapInArrow(partial, schema)
    return some.groupBy("a", "b").applyInArrow(lambda group: pa.table(columns(fold([group]))), schema)


def run_bodies(tasks: DataFrame, bodies: dict[str, tuple[Callable[[dict], bool], Callable[[dict], object]]], kind: str, **constants) -> DataFrame:
    """Each task with the result of the first body that takes it: ``ran`` is its name and ``result`` what it gave.

    A body is (evaluate, work); both see the task's columns and the constants. A task that no
    body takes has nulls.
    """
    names = tasks.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ran, results = [], []
            for row in batch.to_pylist():
                task = {**constants, **row}
                name = next((n for n, (takes, _) in bodies.items() if takes(task)), None)
                ran.append(name)
                results.append(None if name is None else bodies[name][1](task))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ran, pa.string()), pa.array(results)], names=[*names, "ran", "result"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema)
    return tasks.mapInArrow(run, f"{fields}, ran string, result {kind}")


def multiply_blocks(a: DataFrame, b: DataFrame, block: int = 64) -> DataFrame:
    """The product of matrices of whole numbers, block by block: (i, j, v).

    Blocks meet on the inner dimension as arrays, so a product of blocks makes block**2 rows
    where a join of cells would make block**3. Cells that are absent count as 0; cells of the
    product that no term reaches are absent.
    """
    x = with_tiles(a, block, block).groupBy(F.col("m").alias("bi"), F.col("n").alias("bk")).agg(F.collect_list(F.struct("i", "j", "v")).alias("x"))
    y = with_tiles(b, block, block).groupBy(F.col("m").alias("bk"), F.col("n").alias("bj")).agg(F.collect_list(F.struct("i", "j", "v")).alias("y"))
    met = x.join(y, "bk").select("bi", "bk", "bj", "x", "y")

    def dense(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat, offsets = column.flatten(), column.offsets.to_numpy()
        i, j, v = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j", "v"))
        for p, q in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True):
            out, there = np.zeros((block, block), np.int64), np.zeros((block, block), np.int64)
            out[i[p:q] % block, j[p:q] % block] = v[p:q]
            there[i[p:q] % block, j[p:q] % block] = 1
            yield out, there

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for bi, bj, (p, pt), (q, qt) in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), dense(batch.column(3)), dense(batch.column(4)), strict=True):
                i, j = np.nonzero(pt @ qt)
                yield pa.RecordBatch.from_arrays([pa.array(bi * block + i), pa.array(bj * block + j), pa.array((p @ q)[i, j])], names=["i", "j", "v"])

    return met.mapInArrow(run, "i long, j long, v long").groupBy("i", "j").agg(F.sum("v").alias("v"))
