"""Scalar functions on trace columns, and small helpers on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def stream_class(description: Column) -> Column:
    """'cpu', 'gpu', 'network' or 'other' by a stream's description."""
    return F.when(description.rlike("Thread [0-9]+ of VP"), "cpu").when(description.rlike("^GPU [0-9]+-[0-9]+"), "gpu").when(description.startswith("MPI"), "network").otherwise("other")


def stream_number(description: Column) -> Column:
    """The first number of a thread's or GPU's description, else null."""
    n = F.regexp_extract(description, r"(?:Thread|GPU) ([0-9]+)", 1)
    return F.when(n != "", n).cast("int")


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.shiftleft(F.lit(1).cast("long"), bit)) != 0


def red_green_blue(colour: Column) -> Column:
    """Struct of red, green, blue (0 to 255) from six hexadecimal digits, with or without #."""
    n = F.conv(F.regexp_replace(colour, "^#", ""), 16, 10).cast("long")
    return F.struct(*(F.shiftright(n, s).bitwiseAND(255).alias(c) for c, s in (("red", 16), ("green", 8), ("blue", 0))))


def tile_label(m: Column, n: Column) -> Column:
    return F.format_string("(%d, %d)", m, n)


def describe_run(keys: list[str]) -> Column:
    """key=value parts of a run's information, those that are null left out."""
    return F.concat_ws(" ", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys))


def divide(a: Column, b: Column) -> Column:
    """Integer division that cuts towards zero, as C has it; null for a divisor of 0. F.col % is C's remainder already."""
    return F.when(b != 0, F.call_function("div", a.cast("long"), b.cast("long")))


def inline(body: Callable, kind: str) -> Callable[..., Column]:
    """A Python expression over whole columns (pandas Series), for what Column expressions can't say."""
    return F.pandas_udf(body, kind)


def tree_height(tiles: int) -> int:
    """Levels of merges that so many tiles need."""
    return max(0, tiles - 1).bit_length()


def width_at_level(level: Column, tiles: Column) -> Column:
    """Nodes of a merge tree at a level: half of those below, rounded up, each time."""
    size = F.pow(F.lit(2.0), level).cast("long")
    return F.call_function("div", tiles + size - 1, size)


def merged_size(level: Column, i: Column, tile: int, tiles: Column) -> Column:
    """Values that node ``i`` of a level holds: a full subtree's, but for the last node, which holds the rest; null past the end."""
    full = F.pow(F.lit(2.0), level).cast("long") * tile
    width = width_at_level(level, tiles)
    return F.when(i < width - 1, full).when(i == width - 1, tiles * tile - full * (width - 1))


def replace_last(text: str, old: str, new: str, count: int = 1) -> str:
    """``text`` with the last ``count`` places of ``old`` replaced."""
    parts = text.rsplit(old, count)
    return new.join(parts)


def common_substring(names: list[str]) -> str:
    """The longest string that all names hold; the first of equally long ones."""
    first = min(names, key=len, default="")
    for n in range(len(first), 0, -1):
        for i in range(len(first) - n + 1):
            if all(first[i : i + n] in x for x in names):
                return first[i : i + n]
    return ""


def parse_range(text: str) -> list[int]:
    """'a', 'a:b' or 'a:b:step', b included."""
    if not re.fullmatch(r"-?\d+(?::-?\d+){0,2}", text):
        raise ValueError(f"not a range: {text}")
    a, b, step = [*map(int, text.split(":")), None, None][:3]
    b, step = a if b is None else b, 1 if step is None else step
    return list(range(a, b + (1 if step > 0 else -1), step))


def lookup_alias(names: list[str], wanted: str) -> str | None:
    """A column for a name: itself, with or without PARAM_ before it, in any case."""
    plain = lambda s: s.upper().removeprefix("PARAM_")
    return wanted if wanted in names else next((n for n in names if plain(n) == plain(wanted)), None)
