"""Tables that outlive a stage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below what spark.checkpoint.dir names; where it names none, a local session gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/weft-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again, which ends its lineage."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
