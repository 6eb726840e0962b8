"""Structured Streaming over event tables: windowed counts, sessions and removal of repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.session import shared_dir


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a parquet table, a file or a folder; ``ts`` becomes the instant of that time in UTC."""
    folder, _, name = path.rpartition("/")
    # a stream's path must match as a pattern where it is a single file
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")
    return instants(rows)


def instants(rows: DataFrame) -> DataFrame:
    if rows.schema["ts"].dataType.simpleString() != "timestamp_ntz":
        return rows
    return rows.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS timestamp)"))


def wall_time(ts: Column) -> Column:
    """The UTC time of an instant, without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def run_to_end(query: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    State and results lie in the shared folder. In complete mode each batch replaces the result.
    """
    spark = query.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = query.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode(mode)
    if mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{folder}/out")


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    grouped = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value_sum")).select(F.col("w.start").alias("start"), "event_type", "n", "value_sum")


def sliding_counts(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "3650 days").dropDuplicates(["event_id"])
