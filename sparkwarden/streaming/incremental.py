"""Extension: findings of files as they arrive, new ones only, by Structured Streaming.

Each micro-batch runs the batch operators on its files and keeps what the stored baseline has not; a batch is written
under its epoch, so that a retried one replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwarden.operators.suppression import known

FILES = "file string, content string"


def new_findings(spark: SparkSession, source: str, detect: Callable[[DataFrame], DataFrame], out: str, state: str, baseline: DataFrame | None = None) -> StreamingQuery:
    """Start a query over Parquet files(file, content) in `source`; it ends when what is there is read."""

    def batch(df: DataFrame, epoch: int) -> None:
        found = detect(df)
        if baseline is not None:
            found = known(found, baseline, kind="left_anti")
        found.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    stream = spark.readStream.schema(FILES).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event type and window; on a stream, late rows up to the watermark are counted."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
