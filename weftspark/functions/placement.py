"""Owners of tiles, as columns of the tile coordinates m and n."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _div(a: Column, b: int) -> Column:
    """Whole division that rounds down, exact for all longs."""
    return F.call_function("div", a.cast("long") - F.pmod(a.cast("long"), F.lit(b)), F.lit(b).cast("long"))


@dataclass(frozen=True)
class Grid:
    """P x Q processes in row-major order; the first tile's process is (ip, jq)."""

    p: int
    q: int
    ip: int = 0
    jq: int = 0

    def rank(self, row: Column, col: Column) -> Column:
        return row * self.q + col

    def position(self, rank: Column) -> tuple[Column, Column]:
        return _div(rank, self.q), rank % self.q


def block_cyclic(m: Column, n: Column, g: Grid, di: int = 0, dj: int = 0) -> Column:
    """Of a tile of a window that begins at tile (di, dj)."""
    return g.rank((m + di + g.ip) % g.p, (n + dj + g.jq) % g.q)


def k_cyclic(m: Column, n: Column, g: Grid, kp: int, kq: int) -> Column:
    """Blocks of kp x kq tiles are dealt in turn."""
    return block_cyclic(_div(m, kp), _div(n, kq), g)


def k_view(x: Column, p: int, ps: int, size: int) -> Column:
    """A view's tile row (or column) in storage: groups of p * ps are permuted, again until it is in range.

    A permutation of p * ps places is back where it began after so many turns at most, so a
    place in range is always found.
    """
    def turn(v: Column) -> Column:
        return v - v % (p * ps) + (v % ps) * p + _div(v, ps) % p

    # A fold over the turns: nesting the expression in itself would make it grow fourfold with each.
    return F.aggregate(F.sequence(F.lit(1), F.lit(p * ps)), turn(x).cast("long"), lambda v, _: F.when(v >= size, turn(v)).otherwise(v).cast("long"))


def symmetric(m: Column, n: Column, g: Grid, lower: bool = True) -> Column:
    """Only the stored triangle has owners; others get null."""
    return F.when(m >= n if lower else m <= n, g.rank(m % g.p, n % g.q))


def symmetric_block_cyclic(m: Column, n: Column, r: int, extended: bool = False, lower: bool = True) -> Column:
    """Owners by unordered pairs of coordinates modulo r.

    Pair {a, b} with a < b has rank b (b - 1) / 2 + a. On the diagonal the basic form has
    r / 2 more ranks. The extended form uses pairs there too: place d is paired with d + l,
    going round past r, where l goes round by column block. An odd r has (r - 1) / 2 such
    patterns. An even r has r / 2 - 1 of them and r / 2 more, in which the left half's l lags
    one behind: it is r / 2 in the first of these, and the right half is paired with the left
    in the last.
    """
    a, b = m % r, n % r
    pair = lambda x, y: _div(F.greatest(x, y) * (F.greatest(x, y) - 1), 2) + F.least(x, y)
    if extended:
        half = r // 2
        plain = half if r % 2 else half - 1
        pattern = _div(n, r) % (plain if r % 2 else r - 1)
        step = pattern + 1
        if r % 2 == 0:
            shifted = pattern - plain
            left = F.when(shifted == 0, half).otherwise(shifted)
            right = F.when(shifted == plain, half).otherwise(shifted + 1)
            step = F.when(shifted < 0, step).when(a < half, left).otherwise(right)
        diagonal = pair(a, (a + step) % r)
    else:
        diagonal = F.lit(r * (r - 1) // 2) + a % (r // 2)
    return F.when(m >= n if lower else m <= n, F.when(a != b, pair(a, b)).otherwise(diagonal))


def in_band(m: Column, n: Column, size: int) -> Column:
    return F.abs(m - n) < size


def band(m: Column, n: Column, size: int, on: Grid, off: Grid) -> Column:
    """Band tiles, their rows counted from the band's edge, by one grid; the others by another."""
    return F.when(in_band(m, n, size), block_cyclic(m - n + size - 1, n, on)).otherwise(block_cyclic(m, n, off))


def symmetric_band(m: Column, n: Column, size: int, on: Grid, off: Grid, lower: bool = True) -> Column:
    return F.when(m >= n if lower else m <= n, F.when(in_band(m, n, size), block_cyclic(F.abs(m - n), n, on)).otherwise(symmetric(m, n, off, lower)))


def vector(m: Column, g: Grid, kind: str) -> Column:
    """A vector's segment: along a process 'row', 'col' or the 'diag'onal."""
    return g.rank(m % g.p if kind != "col" else F.lit(0), m % g.q if kind != "row" else F.lit(0))


def tabular(tiles: DataFrame, owners: DataFrame, rows: int) -> DataFrame:
    """By a table of ``key`` = n * rows + m and ``owner``."""
    return tiles.withColumn("key", F.col("n") * rows + F.col("m")).join(owners, "key", "left").drop("key")


def hashed(tiles: DataFrame, owners: DataFrame, key: str, nodes: int) -> DataFrame:
    """By a key table; a key that isn't there belongs to ``nodes``."""
    return tiles.join(owners, key, "left").withColumn("owner", F.coalesce("owner", F.lit(nodes)))


def random_owner(m: Column, n: Column, nodes: int, seed: int = 0) -> Column:
    """The same owner for the same tile and seed."""
    return F.pmod(F.xxhash64(m, n, F.lit(seed)), F.lit(nodes))


def within_node(m: Column, n: Column, g: Grid, vp: int, vq: int) -> Column:
    """The virtual process in a node: what is dealt to the node is dealt again to vp x vq."""
    return (_div(m, g.p) % vp) * vq + _div(n, g.q) % vq
