"""Jump consistent hashing of stable keys to shards, with DataFrame functions only.

The key's 64-bit linear congruential sequence is worked out in 32-bit halves, so no
product leaves the range of a signed long and ANSI mode never raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The multiplier of the generator, as halves and the low half's halves.
FACTOR = 2862933555777941757
HIGH, LOW = FACTOR >> 32, FACTOR & 0xFFFFFFFF
LOW_HIGH, LOW_LOW = LOW >> 16, LOW & 0xFFFF
HIGH_HIGH, HIGH_LOW = HIGH >> 16, HIGH & 0xFFFF
MASK = 0xFFFFFFFF
#: Turns a key into another start of the generator.
SALT = 0x5DEECE66D


def _low_product(x: Column, high: int, low: int) -> Column:
    """The low 32 bits of x times the number with these 16-bit halves, x below 2**32."""
    return (x * low + F.shiftleft((x * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _next(h: Column, l: Column) -> tuple[Column, Column]:  # noqa: E741
    """The halves of key * FACTOR + 1 modulo 2**64."""
    upper = l * LOW_HIGH
    low = l * LOW_LOW + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    high = carry + _low_product(h, LOW_HIGH, LOW_LOW) + _low_product(l, HIGH_HIGH, HIGH_LOW)
    return high.bitwiseAND(MASK), low.bitwiseAND(MASK)


def jump_shards(key: Column, *counts: int) -> Column:
    """A struct with field ``n<count>`` for each count: the shard of a long key.

    Adding a shard moves a key either nowhere or into the new shard. A null key is taken as 0.
    """
    if not counts or min(counts) < 1:
        raise ValueError("shard counts must be 1 or more")
    most = max(counts)
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(MASK).alias("l"), zero.alias("j"),
        *(zero.alias(f"n{n}") for n in counts),
    )

    def step(s: Column, _: Column) -> Column:
        h, l = _next(s["h"], s["l"])  # noqa: E741
        ahead = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double")))
        go = s["j"] < most
        return F.struct(
            h.alias("h"), l.alias("l"), F.when(go, ahead).otherwise(s["j"]).cast("long").alias("j"),
            *(F.when(s["j"] < n, s["j"]).otherwise(s[f"n{n}"]).alias(f"n{n}") for n in counts),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    return F.struct(*(walked[f"n{n}"].cast("int").alias(f"n{n}") for n in counts))


def spread(key: Column, buckets: int) -> Column:
    """A bucket of a long key: the high bits of one step of the generator from another start than shards take."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long")).bitwiseXOR(F.lit(SALT).cast("long"))
    high, _ = _next(F.shiftrightunsigned(key, 32), key.bitwiseAND(MASK))
    return F.shiftright(high * buckets, 32).cast("int")


def shard(df: DataFrame, key: str, shards: int, *, size: Column | None = None, buckets: int = 1024) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in a shard).

    Slots are dealt in two steps, so no shard's rows meet in one task: keys are hashed to
    ``buckets`` per shard, rows are numbered within a bucket, and a bucket starts where the
    ones before it end. Null keys share one key, so one shard, whose buckets they are dealt to by
    their ties; rows with equal keys share a shard and get different slots; an empty table stays
    empty. Texts play no part, whatever their length. All other columns are kept; ``shard``,
    ``grown_shard`` and ``slot`` are replaced where the input has them.
    """
    own = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    # Longer names than any of the input's, so none of its columns is hidden.
    long = "_" * (1 + max(map(len, own)))
    n, b, k, r = (long + x for x in "nbkr")
    ties = [F.col(key)] + ([size] if size is not None else [])
    bucket = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*ties), F.lit(buckets)).cast("int")).otherwise(spread(F.col(key), buckets))
    keyed = df.select(*own, jump_shards(F.col(key), shards, shards + 1).alias(n), bucket.alias(b))
    keyed = keyed.select(*own, F.col(f"{n}.n{shards}").alias("shard"), F.col(f"{n}.n{shards + 1}").alias("grown_shard"), b)
    counted = keyed.groupBy("shard", b).agg(F.count(F.lit(1)).alias(k))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", b, F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k))
    numbered = keyed.withColumn(r, F.row_number().over(Window.partitionBy("shard", b).orderBy(*ties)) - 1)
    return numbered.join(starts, ["shard", b]).select(*own, "shard", "grown_shard", (F.col(k) + F.col(r)).cast("long").alias("slot"))


def documents_in_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; a null text has 0 bytes."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard(sized, "doc_id", shards, size=F.struct("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
