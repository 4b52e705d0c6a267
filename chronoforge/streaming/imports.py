"""Imports of files as they arrive: stateless streams that append to a Parquet store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronoforge.functions.times import store_time
from chronoforge.sources import jsonl, store, tln


def lines(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)


def import_lines(spark: SparkSession, folder: str, kind: str, out: str, checkpoint: str) -> StreamingQuery:
    """Imports all new files of a folder (jsonl, tln or l2ttln), once each, then ends.

    A batch that is run again after a failure is told by its name, of checkpoint and number, and not added twice.
    """
    raw = lines(spark, folder)
    events = jsonl.lines_to_events(raw) if kind == "jsonl" else tln.lines_to_events(raw, 5 if kind == "tln" else 7)

    def add(batch: DataFrame, number: int) -> None:
        store.append(batch.filter("ok").drop("ok"), out, batch=f"{checkpoint}#{number}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_histogram(events: DataFrame, late: str = "1 hour", bucket: str = "1 hour") -> DataFrame:
    """bucket, cnt of a stream of events, by event time, with a bound on lateness."""
    ts = events.select(store_time(F.col("datetime")).cast("timestamp").alias("ts")).filter("ts IS NOT NULL").withWatermark("ts", late)
    return ts.groupBy(F.window("ts", bucket)).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("bucket"), "cnt")


def write_histogram(events: DataFrame, out: str, checkpoint: str, late: str = "1 hour", bucket: str = "1 hour") -> StreamingQuery:
    """Counts all that has come, then ends: each bucket is written to Parquet once, when the watermark has passed its end.

    Run it again with its checkpoint to go on: buckets that are open are kept there, and none is written twice. Events of buckets that
    are closed (their end is not after the greatest time seen so far, less the bound on lateness) are dropped. Read ``out`` with Spark.
    """
    counts = live_histogram(events, late, bucket).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))
    return counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
