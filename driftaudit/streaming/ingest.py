"""Incremental runs: snapshots that arrive as files, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_new(spark: SparkSession, schema, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what arrived in `source` (Parquet files) since the last run to `out`; a run without new files does nothing."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, lateness: str = "1 hour", size: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) over event time; rows later than the watermark are dropped, as streams must."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def stage(spark: SparkSession, todo: DataFrame, key: str, path: str, compute) -> DataFrame:
    """A stage table keyed by content: only keys that `path` doesn't have are computed and appended; returns all of `todo`'s results."""
    try:
        have = spark.read.parquet(path)
        missing = todo.join(have.select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        missing = todo
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(todo.select(key).distinct(), key, "left_semi")
