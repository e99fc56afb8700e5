"""Structured Streaming adapters: event routing, and label or detector sessions.

Sessions with watermarks are an addition; the batch operators define their meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.events import catalogue_rows, insert_if_absent, route_events


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def sessions(stream: DataFrame, time: str, gap: str, key: str = "v", late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events at most ``gap`` apart: key, start, end, n.  Touching events are one session."""
    g = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def tumbling(stream: DataFrame, time: str, width: str, key: str = "v", late: str = "10 minutes") -> DataFrame:
    """Counts of a key's events by tumbling window."""
    g = stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def route_stream(events: DataFrame, catalogue_path: str, checkpoint: str) -> StreamingQuery:
    """Routes a stream of events and appends the new uploads to a Parquet catalogue, once each."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = catalogue_rows(route_events(batch))
        try:
            known = spark.read.parquet(catalogue_path)
        except Exception as e:  # the first batch finds no catalogue
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], rows.schema)
        insert_if_absent(rows, known).write.mode("append").parquet(catalogue_path)

    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
