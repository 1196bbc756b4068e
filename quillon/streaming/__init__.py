"""Incremental forms: file-source ingestion, state with a time to live, windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def live(cache: DataFrame, now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """The newest entry of each key that is not older than its time to live."""
    newest = cache.groupBy("key").agg(F.max_by("payload", ts).alias("payload"), F.max(ts).alias(ts))
    return newest.where(F.col(ts) > now - F.make_dt_interval(secs=F.lit(float(seconds)).cast("decimal(18,6)")))


def ingest(spark: SparkSession, path: str, schema: str, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process all new files once and append the results; each batch is committed as a whole."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: process(df).write.mode("append").parquet(out)).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str, late: str, size: str, by: list[str]) -> DataFrame:
    """Counts per event-time window, on a stream or a table."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
