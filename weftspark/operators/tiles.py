"""Operators over matrices as cells (i, j, v), tiles being (i div mb, j div nb)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftspark.functions.placement import _div

FULL, UPPER, LOWER = "full", "upper", "lower"


def with_tiles(cells: DataFrame, mb: int, nb: int) -> DataFrame:
    return cells.withColumns({"m": _div(F.col("i"), mb), "n": _div(F.col("j"), nb)})


def tile_count(length: int, begin: int, block: int) -> int:
    """Tiles that a window of ``length`` from ``begin`` reaches."""
    return (begin + length - 1) // block - begin // block + 1


def map_cells(source: DataFrame, op: Callable[[Column], Column], dest: DataFrame | None = None, combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """op of each cell; with ``dest``, combine(source, dest) where both have the cell."""
    if dest is None:
        return source.select("i", "j", op(F.col("v")).alias("v"))
    other = dest.select("i", "j", F.col("v").alias("_d"))
    return source.join(other, ["i", "j"]).select("i", "j", combine(F.col("v"), F.col("_d")).alias("v"))


def region(kind: str, diagonal: bool = True) -> Column:
    """Whether a cell is in the region; triangles with or without the diagonal."""
    i, j = F.col("i"), F.col("j")
    if kind == FULL:
        return F.lit(True)
    if kind == UPPER:
        return j >= i if diagonal else j > i
    if kind == LOWER:
        return i >= j if diagonal else i > j
    raise ValueError(f"not a region: {kind}")


def apply_region(cells: DataFrame, kind: str, op: Callable[[Column], Column], diagonal: bool = True) -> DataFrame:
    """op of the cells in a region; the others stay. Also how a partial tile is reset."""
    return cells.withColumn("v", F.when(region(kind, diagonal), op(F.col("v"))).otherwise(F.col("v")))


def triangle_tiles(cells: DataFrame, lower: bool = True) -> DataFrame:
    """Cells of the tiles strictly below (or above) the diagonal tiles."""
    return cells.filter("m > n" if lower else "m < n")


def submatrix(cells: DataFrame, i: int, j: int, rows: int, cols: int) -> DataFrame:
    """A window, its cells counted from its corner."""
    if min(i, j) < 0 or min(rows, cols) < 1:
        raise ValueError("a window needs a place and a size")
    inside = cells.filter(F.col("i").between(i, i + rows - 1) & F.col("j").between(j, j + cols - 1))
    return inside.withColumns({"i": F.col("i") - i, "j": F.col("j") - j})


def subtile(cells: DataFrame, m: int, n: int, mb: int, nb: int, smb: int, snb: int) -> DataFrame:
    """One tile cut into smaller ones."""
    return with_tiles(submatrix(cells, m * mb, n * nb, mb, nb), smb, snb)


def band_to_rectangle(cells: DataFrame, width: int, columns: int, block: int, pad: int = 2) -> DataFrame:
    """Row r of column j holds A[j + r, j] for r up to ``width``; ``pad`` zero columns follow each tile's ``block`` columns."""
    spark = cells.sparkSession
    kept = cells.filter(f"i - j BETWEEN 0 AND {width} AND j < {columns}").select((F.col("i") - F.col("j")).alias("r"), F.col("j").alias("c"), "v")
    placed = kept.select("r", (F.col("c") + _div(F.col("c"), block) * pad).alias("c"), "v")
    total = columns + -(-columns // block) * pad
    grid = spark.range(width + 1).withColumnRenamed("id", "r").crossJoin(F.broadcast(spark.range(total).withColumnRenamed("id", "c")))
    return grid.join(placed, ["r", "c"], "left").select("r", "c", F.coalesce("v", F.lit(0)).alias("v"))


def reduce_tiles(cells: DataFrame, mb: int, nb: int, agg: Callable[[str], Column], by: str = "all") -> DataFrame:
    """Element-wise reduction of tiles: of all, of each tile 'row', or of each tile 'col'umn."""
    t = with_tiles(cells, mb, nb).withColumns({"a": F.col("i") % mb, "b": F.col("j") % nb})
    keys = {"all": [], "row": ["m"], "col": ["n"]}[by]
    return t.groupBy(*keys, "a", "b").agg(agg("v").alias("v"))


def forest_of(count: int) -> list[tuple[int, int]]:
    """(size, first) of the power-of-two trees that ``count`` leaves fall into, smallest first."""
    out, at = [], 0
    for bit in range(count.bit_length()):
        if count >> bit & 1:
            out.append((1 << bit, at))
            at += 1 << bit
    return out


def all_reduce(cells: DataFrame, agg: Callable[[str], Column]) -> DataFrame:
    """Every cell with the reduction of its column."""
    total = cells.groupBy("j").agg(agg("v").alias("total"))
    return cells.join(total, "j")


def multiply(a: DataFrame, b: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """C + A B, C being nought where absent."""
    x, y = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    terms = x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return terms if c is None else terms.unionByName(c.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def redistribute(source: DataFrame, target: DataFrame, rows: int, cols: int, at: tuple[int, int], to: tuple[int, int], source_shape: tuple[int, int], target_shape: tuple[int, int]) -> DataFrame:
    """The target with a window of the source copied over it; null values are copied too."""
    if min(rows, cols) < 1 or min(*at, *to) < 0:
        raise ValueError("a window needs a size of 1 or more and a place of 0 or more")
    for (i, j), (h, w) in ((at, source_shape), (to, target_shape)):
        if i + rows > h or j + cols > w:
            raise ValueError("the window is not inside the matrix")
    window = submatrix(source, *at, rows, cols)
    moved = window.select((F.col("i") + to[0]).alias("i"), (F.col("j") + to[1]).alias("j"), F.col("v").alias("_v"), F.lit(True).alias("_p"))
    return target.join(moved, ["i", "j"], "left").select("i", "j", F.when(F.col("_p"), F.col("_v")).otherwise(F.col("v")).alias("v"))


def reshuffle(source: DataFrame, target: DataFrame, dm: int, dn: int, sizes: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Whole tiles (m, n, tile), moved by (dm, dn) tiles over the target's; null tiles are moved too.

    ``sizes`` (rows and columns of a source tile, then of a target tile) have to agree.
    """
    if sizes is not None and sizes[:2] != sizes[2:]:
        raise ValueError("tiles of different sizes can't be moved whole")
    moved = source.select((F.col("m") + dm).alias("m"), (F.col("n") + dn).alias("n"), F.col("tile").alias("_t"), F.lit(True).alias("_p"))
    return target.join(moved, ["m", "n"], "left").select("m", "n", F.when(F.col("_p"), F.col("_t")).otherwise(F.col("tile")).alias("tile"))


def window_is_stored(rows: int, cols: int, at: tuple[int, int], lower: bool | None = None) -> bool:
    """Whether a window lies in the stored triangle (``lower`` or upper; None stores all)."""
    i, j = at
    return lower is None or (i >= j + cols - 1 if lower else j >= i + rows - 1)


def reshape(cells: DataFrame, kind: str, to: str | None = None, diagonal: bool = True) -> DataFrame:
    """The cells of a region alone, in another type where ``to`` names one that differs."""
    kept = cells if kind == FULL else cells.filter(region(kind, diagonal))
    return kept if to is None or kept.schema["v"].dataType.simpleString() == to else kept.withColumn("v", F.col("v").cast(to))


def broadcast_root(data: DataFrame, root: Column, receivers: DataFrame) -> DataFrame:
    """Each receiver with the root's value. The root is one row, so it is broadcast."""
    return receivers.crossJoin(F.broadcast(data.filter(root).limit(1)))


def stencil(cells: DataFrame, weights: dict[int, float], rounds: int = 1, each: Callable[[DataFrame], DataFrame] | None = None, width: int = 1024) -> DataFrame:
    """Weighted sums of neighbours along j, nought past the ends. ``each`` may cut the lineage after a round.

    Columns are cut into tiles of ``width``; a tile gets copies of the cells that its edges
    need, so a task holds a tile of a row and not the row.
    """
    if not any(k for k in weights):
        raise ValueError("a radius of 1 or more is asked for")
    radius = max(abs(k) for k in weights)
    if radius > width:
        raise ValueError("a tile is no narrower than the radius")
    w = Window.partitionBy("i", "_t").orderBy("j")

    def at(k: int) -> Column:
        v = F.col("v") if k == 0 else F.lag("v", -k).over(w) if k < 0 else F.lead("v", k).over(w)
        return F.coalesce(v, F.lit(0))

    for _ in range(rounds):
        reached = F.array_distinct(F.array(*(_div(F.col("j") + k, width) for k in (-radius, 0, radius))))
        copies = cells.select("i", "j", "v", F.explode(reached).alias("_t"))
        summed = copies.select("i", "j", "_t", reduce(lambda a, b: a + b, [at(k) * F.lit(x) for k, x in sorted(weights.items())]).alias("v"))
        cells = summed.filter(_div(F.col("j"), width) == F.col("_t")).select("i", "j", "v")
        cells = each(cells) if each else cells
    return cells


def standard_weights(radius: int) -> dict[int, float]:
    """1 in the middle, 1 / (2 k radius) at k, and its negative at -k."""
    return {0: 1.0} | {s * k: s / (2 * k * radius) for k in range(1, radius + 1) for s in (1, -1)}


def all_to_all(nodes: DataFrame, repeats: int) -> DataFrame:
    """(r, s, t): every node receives from every node, so many times. The nodes are few by their nature."""
    few = nodes.select(F.col("id").alias("s"))
    return few.crossJoin(nodes.select(F.col("id").alias("t"))).select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("r"), "s", "t")
