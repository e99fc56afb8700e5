"""Timeline views of the star-schema test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of timelines in a task: the deepest plan (``score_gate``) sorts them many times at once, at about 1.2 kB a row.
TASK_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_timeline(df: DataFrame, rows: int, least: int = TASK_ROWS) -> DataFrame:
    """``df`` of ``rows`` rows, dealt by timeline so that a task has about ``least`` of them, however long the table.

    A fixed number of shuffle partitions, or partitions joined up to a size on disk, would let the sorts of one task grow with it.
    """
    if rows <= least:
        return df
    return df.repartition(max(math.ceil(rows / least), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "v")


def seconds(ts: str) -> F.Column:
    """Seconds since 2024, scaled, of a zone-less timestamp."""
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return (F.unix_micros(F.col(ts).cast("timestamp")) - base) / F.lit(1e6) / F.lit(600.0)


def regions(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """Detector regions (v, ord, start, end, kind) from events; ``dealt`` by timeline, unless a query has no use for it."""
    kind = F.create_map(*(F.lit(x) for p in (("click", "black"), ("view", "white"), ("purchase", "bars"), ("signup", "snow"), ("error", "silence")) for x in p))
    events = read(spark, sf_dir, "events")
    out = events.select(F.col("user_id").alias("v"), F.col("event_id").alias("ord"), seconds("ts").alias("start"), "value", kind[F.col("event_type")].alias("kind"))
    out = out.select("v", "ord", "start", (F.col("start") + F.col("value") * F.lit(0.5)).alias("end"), F.coalesce("kind", F.lit("freeze")).alias("kind"))
    return by_timeline(out, events.count()) if dealt else out


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns (v, ord, speaker, start, end, text) from conversations, on whole microseconds."""
    n = F.length("text")
    own = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("v"), F.col("turn").alias("ord"), F.col("role").alias("speaker"), "text", F.floor(n * 1000000 / 15).alias("dur"), ((n % 5) * 750000).alias("pause"))
    before = Window.partitionBy("v").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    at = own.withColumn("at", F.coalesce(F.sum(F.col("dur") + F.col("pause")).over(before), F.lit(0)))
    return at.select("v", "ord", "speaker", (F.col("at") / F.lit(1e6)).alias("start"), ((F.col("at") + F.col("dur")) / F.lit(1e6)).alias("end"), "text")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label samples (v, ord, t, label) from events."""
    events = read(spark, sf_dir, "events")
    return by_timeline(events.select(F.col("user_id").alias("v"), F.col("event_id").alias("ord"), seconds("ts").alias("t"), F.col("event_type").alias("label")), events.count())


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one turn each."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("v"), F.lit(0).cast("long").alias("ord"), F.lit("spk_0").alias("speaker"), F.lit(0.0).alias("start"), (F.col("n_chars") / F.lit(15.0)).alias("end"), "text")
