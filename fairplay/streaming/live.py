"""Live counts on the request stream (Structured Streaming).

``read_request_stream`` reads the events parquet as a file stream (the
``ts`` column is TIMESTAMP_NTZ in storage and is cast to TIMESTAMP so a
watermark can be set). The count functions are plain DataFrame code, so the
same function runs on the batch table and on the stream; tests check that
both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def as_requests(events: DataFrame) -> DataFrame:
    tier = F.element_at(F.array(F.lit("free"), F.lit("premium"), F.lit("enterprise")),
                        (F.pmod(F.col("user_id"), F.lit(3)) + 1).cast("int"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("client"),
        F.col("event_type").alias("endpoint"), tier.alias("tier"))


def read_request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_requests(reader.parquet(path))


def tumbling_counts(requests: DataFrame, window: str = "1 hour", watermark: str = "10 minutes",
                    key: str = "endpoint") -> DataFrame:
    """Requests per key and tumbling window; append mode emits each window once final."""
    return (requests.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    key, "requests"))


def sliding_counts(requests: DataFrame, window: str = "1 hour", slide: str = "15 minutes",
                   watermark: str = "10 minutes", key: str = "endpoint") -> DataFrame:
    return (requests.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window, slide).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    key, "requests"))


def session_counts(requests: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes",
                   key: str = "client") -> DataFrame:
    """Activity sessions per client (a session closes after ``gap`` of silence)."""
    return (requests.withWatermark("ts", watermark)
            .groupBy(F.session_window("ts", gap).alias("s"), key)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    key, "requests"))


def dedup_requests(requests: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Drop replayed requests (same event_id) seen within the watermark delay."""
    return requests.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run a streaming DataFrame to completion over the available files (tests, bench)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
