"""Event windows and sessions as streams in update mode, with a sink that a repeated batch can't write twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def distinct_events(events: DataFrame, key: str = "event_id", delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Each event once: repeats that come within `delay` of each other are dropped, and state is kept for no longer."""
    d = events.withWatermark(ts, delay)
    return d.dropDuplicatesWithinWatermark([key]) if events.isStreaming else d.dropDuplicates([key])


def window_counts(events: DataFrame, width: str = "7 days", ts: str = "ts") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows. Windows start at multiples of the width since 1970; null times have none."""
    d = events.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", by: str = "user_id", ts: str = "ts") -> DataFrame:
    """(by, start, end, n, total) of runs of events with less than `gap` between neighbours; end is the last event's time.

    Spark merges sessions in state and in partial aggregates, so a user's events are never gathered. Null times have no session.
    """
    d = events.groupBy(F.session_window(ts, gap), by).agg(F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(by, F.col("session_window.start").alias("start"), "end", "n", "total")


def keyed_writer(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    """A writer whose batches lie in folders of their number: a batch that runs again replaces what it wrote before."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("updated", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of rows that batches have written for a key, that of the last batch: one aggregation by key."""
    d = spark.read.parquet(path).drop("batch")
    cols = [c for c in d.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "updated").alias("__x")).select(*keys, "__x.*").drop("updated")
