"""Queries that run a stream over the events table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.plans.trace import EV
from weftspark.sources.shared import folder
from weftspark.streaming import live

QUERIES, SQL = {}, {}


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    e = live.points(spark, f"{sf}/events.parquet*", schema)
    return e.select(F.col("event_type").alias("key"), (F.col("user_id") % 4).alias("process"), (F.col("event_id") % 5).alias("unit"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 1704067200).alias("x"), F.round(F.col("value") * 100).alias("y"))


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there; each batch is a folder of its own, so one that is run again replaces itself."""
    spark, path = stream.sparkSession, folder(stream.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
    if mode == "complete":  # the last batch has everything
        done = done.join(done.agg(F.max("batch").alias("batch")), "batch")
    return done


def live_reduce(spark: SparkSession, sf: str) -> DataFrame:
    out = live.reduced(_finished(live.latest(_stream(spark, sf)), "complete"))
    return out.select("key", "process", F.col("y").cast("long").alias("y"), F.round("x", 3).alias("x"))


def live_slopes(spark: SparkSession, sf: str) -> DataFrame:
    out = _finished(live.slopes(_stream(spark, sf)), "append")
    return out.select("key", "process", "unit", "id", F.round("slope", 3).alias("slope"))


def live_buffers(spark: SparkSession, sf: str) -> DataFrame:
    out = _finished(live.buffers(_stream(spark, sf)), "update")
    last = out.groupBy("key", "process", "unit").agg(F.max_by(F.struct("visible", "oldest"), "batch").alias("m"))
    return last.select("key", "process", "unit", "m.visible", F.round("m.oldest", 3).alias("oldest"))


QUERIES |= {"live_reduce": live_reduce, "live_slopes": live_slopes, "live_buffers": live_buffers}
_P = EV + ", p AS (SELECT type AS key, node AS process, id % 5 AS unit, id, time::DOUBLE / 1000000 - 1704067200 AS x, size::DOUBLE AS y FROM ev)"
SQL["live_reduce"] = f"WITH {_P}, l AS (SELECT key, process, unit, max_by(y, x) AS y, max(x) AS x FROM p GROUP BY ALL) SELECT key, process, CAST(sum(y) AS BIGINT) AS y, round(avg(x), 3) AS x FROM l GROUP BY key, process"
SQL["live_slopes"] = f"WITH {_P}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY key, process, unit ORDER BY x, id)) SELECT key, process, unit, id, round(dy / dx, 3) AS slope FROM d WHERE abs(dx) > 0.0001"
SQL["live_buffers"] = f"""WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY key, process, unit ORDER BY x, id) AS k, count(*) OVER (PARTITION BY key, process, unit) AS c FROM p),
v AS (SELECT *, CASE WHEN c <= 200 THEN c ELSE 101 + (c - 201) % 100 END AS visible FROM n) SELECT key, process, unit, visible, round(x, 3) AS oldest FROM v WHERE k = c - visible + 1"""
