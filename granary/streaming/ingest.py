"""Streams of files into stored tables, each key once, resumable; and event-time aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from granary.operators.joins import first_per_key, missing
from granary.sources.sinks import exists


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame] | None = None, target: int | None = None) -> StreamingQuery:
    """Append to the Parquet table at path the rows whose key it doesn't have; encode only these. Stops adding at `target` rows.

    A batch that is run again finds its rows stored and adds none, so each row is stored once.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = first_per_key(batch, key, [key])
        stored = spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else None
        if stored is not None:
            rows = missing(rows, stored, key)
        if target is not None:
            rows = rows.orderBy(key).limit(max(0, target - (stored.count() if stored is not None else 0)))
        (encode(rows) if encode else rows).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, folder: str, schema: StructType | str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def tumbling(events: DataFrame, size: str, late: str, by: list[str]) -> DataFrame:
    """Counts and sums by window and group; an extension. Works on streams and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """Sessions of a user, which end after a gap; an extension."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, key: str, late: str) -> DataFrame:
    """Events without repeats that come within the watermark; an extension, for streams."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
