"""Storage events: routing, validation, insert-if-absent, and the batch scripts' relational steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalars import basename, is_video_file, stem
from spanloom.schemas import EVENT, TRIM_REQUEST

MIN_BYTES = 1 << 20


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """Event messages to rows: id, event, bucket, key (decoded), size."""
    each = raw.select(F.posexplode(F.from_json(value, EVENT)["Records"]).alias("id", "r"))
    return each.select(F.col("id").cast("long"), F.col("r.eventName").alias("event"), F.col("r.s3.bucket.name").alias("bucket"), F.expr("try_url_decode(r.s3.object.key)").alias("key"), F.col("r.s3.object.size").alias("size"))


def route_events(events: DataFrame) -> DataFrame:
    """Adds ``route`` (skip_copy, trim, segment, skip, reject_size, reject_type or process) to (event, key, size)."""
    key = F.col("key")
    route = (
        F.when(F.col("event").contains("Copy"), "skip_copy")
        .when(key.startswith("edit/") & key.endswith("_trim_request.json"), "trim")
        .when(key.startswith("edit/") & key.endswith("_segment_request.json"), "segment")
        .when(~key.startswith("video/"), "skip")
        .when(F.col("size") < MIN_BYTES, "reject_size")
        .when(~is_video_file(key), "reject_type")
        .otherwise("process")
    )
    return events.withColumn("route", route)


def event_status(routed: DataFrame) -> DataFrame:
    """One row: 200 if any event was processed or skipped, else 400."""
    good = F.max(F.col("route").isin("skip_copy", "skip", "trim", "segment", "process").cast("int"))
    return routed.agg(F.when(good == 1, 200).otherwise(400).alias("status"), F.count("*").alias("events"))


def catalogue_rows(routed: DataFrame) -> DataFrame:
    """Catalogue rows of processed uploads."""
    return routed.filter("route = 'process'").select(stem(F.col("key")).alias("id"), basename(F.col("key")).alias("display_name"), F.col("key").alias("s3_key"), F.lit("UPLOADED").alias("status"), F.col("size").alias("size_bytes"))


def insert_if_absent(rows: DataFrame, catalogue: DataFrame, key: str = "id") -> DataFrame:
    """Rows to append: new keys only, the first of each by all columns."""
    w = Window.partitionBy(key).orderBy(*[c for c in rows.columns if c != key])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(catalogue.select(key), key, "left_anti")


def requests(raw: DataFrame, value: str = "value") -> DataFrame:
    """Valid trim or segment requests: those that name a video."""
    return raw.select(F.from_json(value, TRIM_REQUEST).alias("r")).select("r.*").filter("video_key is not null and video_key <> ''")


def edit_list(reqs: DataFrame) -> DataFrame:
    """Edit decisions of trim requests: the kept spans and where each lands in the output."""
    each = reqs.select("video_key", F.posexplode("keep_segments").alias("ord", "s")).select("video_key", "ord", F.col("s.start").alias("start"), F.col("s.end").alias("end")).filter("end > start")
    before = Window.partitionBy("video_key").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("out_start", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)))


def dedupe_first(df: DataFrame, name: F.Column, order: str) -> DataFrame:
    """The first row of each name."""
    w = Window.partitionBy(name).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def systematic_sample(df: DataFrame, order: str, step: int, groups: str) -> DataFrame:
    """Every ``step``-th row within each group, the first included (works for a step of 1 too)."""
    w = Window.partitionBy(groups).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") - 1) % step == 0).drop("_n")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def hashed_sample(df: DataFrame, name: str, n: int) -> DataFrame:
    """A repeatable sample of ``n`` distinct names."""
    return df.select(name).distinct().orderBy(F.xxhash64(name), name).limit(n)


def expected_versus_detected(expected: DataFrame, detected: DataFrame) -> DataFrame:
    """A validation table: name, expected (POS or TRAP), found, ok."""
    j = expected.join(detected.select("name", F.lit(True).alias("found")).distinct(), "name", "left").na.fill(False, ["found"])
    return j.withColumn("ok", (F.col("expected") == "POS") == F.col("found"))
