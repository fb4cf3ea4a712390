"""Live counters with Structured Streaming: points (key, process, unit, id, x, y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a sliding buffer holds; when it is full, its newer half is kept.
SLOTS = 200


def points(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """A stream of Parquet files; ``files`` a trigger bounds what is in flight."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def slopes(stream: DataFrame, least: float = 1e-4) -> DataFrame:
    """dy/dx of each point and the one before it of its (key, process, unit), across batches, which have to come in the order of x."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values(["x", "id"])
        before = state.get if state.exists else (np.nan, np.nan)
        x, y = (np.concatenate([[b], rows[c].to_numpy(float)]) for c, b in zip(("x", "y"), before, strict=True))
        dx = np.diff(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            moved = np.abs(dx) > least
            slope = np.diff(y) / dx
        if len(rows):
            state.update((float(x[-1]), float(y[-1])))
        own = rows[moved]
        yield pd.DataFrame({"key": key[0], "process": key[1], "unit": key[2], "id": own["id"], "x": own["x"].astype(float), "slope": slope[moved]})

    return stream.groupBy("key", "process", "unit").applyInPandasWithState(step, "key string, process long, unit long, id long, x double, slope double", "x double, y double", "append", GroupStateTimeout.NoTimeout)


def latest(stream: DataFrame) -> DataFrame:
    """Each unit's latest x and y, for update or complete mode."""
    return stream.groupBy("key", "process", "unit").agg(F.max_by("y", F.struct("x", "id")).alias("y"), F.max("x").alias("x"))


def reduced(latest_units: DataFrame) -> DataFrame:
    """Per process: the sum of the units' latest y and the mean of their latest x."""
    return latest_units.groupBy("key", "process").agg(F.sum("y").alias("y"), F.avg("x").alias("x"))


def buffers(stream: DataFrame, slots: int = SLOTS) -> DataFrame:
    """How many points of each (key, process, unit) are visible, and the oldest of them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.array(state.get[0] if state.exists else [], float)
        new = pd.concat(frames).sort_values(["x", "id"])["x"].to_numpy(float)
        while len(new):
            if len(held) >= slots:
                held = held[-(slots // 2) :]
            room = slots - len(held)
            held, new = np.concatenate([held, new[:room]]), new[room:]
        state.update((held.tolist(),))
        yield pd.DataFrame([(*key, len(held), held[0])], columns=["key", "process", "unit", "visible", "oldest"])

    return stream.groupBy("key", "process", "unit").applyInPandasWithState(step, "key string, process long, unit long, visible long, oldest double", "held array<double>", "update", GroupStateTimeout.NoTimeout)
