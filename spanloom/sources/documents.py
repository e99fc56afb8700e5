"""JSON and text sources and sinks: timelines, transcripts, boundary lists, requests, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.schemas import ASR, DOCUMENT, SEGMENT

TURN_LIST = "array<struct<start:double,end:double,speaker:string,text:string>>"


def read_timelines(spark: SparkSession, path: str) -> DataFrame:
    """One row per timeline document, with the file's stem."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def segments_of(docs: DataFrame, key: str = "stem") -> DataFrame:
    """Segments of documents, both spellings of the times; those without a start are left out."""
    each = docs.select(key, F.posexplode_outer(F.coalesce("segments", F.expr(f"cast(array() as array<{SEGMENT}>)"))).alias("ord", "s"))
    return each.select(key, "ord", F.coalesce("s.segment_start", "s.start").alias("start"), F.coalesce("s.segment_end", "s.end").alias("end"), F.col("s.segment_type").alias("type"), "s.title", "s.caption", "s.speakers").filter("start is not null")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts, as a list or under ``turns``; rows that miss a time are dropped, speaker and text have defaults."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("v"), "value")
    both = F.coalesce(F.from_json("value", TURN_LIST), F.from_json("value", f"struct<turns:{TURN_LIST}>")["turns"])
    return text.select("v", F.posexplode(both).alias("ord", "t")).select("v", F.col("ord").cast("long"), F.coalesce("t.speaker", F.lit("spk_?")).alias("speaker"), "t.start", "t.end", F.coalesce("t.text", F.lit("")).alias("text")).dropna(subset=["start", "end"])


def read_boundaries(texts: DataFrame, key: str = "v", value: str = "value", duration: str | None = None) -> DataFrame:
    """Boundary lists in three shapes (document, {boundaries, duration}, bare list): sorted starts and the duration."""
    doc = F.from_json(value, f"struct<segments:array<{SEGMENT}>,boundaries:array<double>,duration:double>")
    segs = doc["segments"]
    starts = F.filter(F.transform(segs, lambda s: F.coalesce(s["segment_start"], s["start"])), lambda x: x.isNotNull())
    ends = F.filter(F.transform(segs, lambda s: F.coalesce(s["segment_end"], s["end"])), lambda x: x.isNotNull())
    bounds = F.array_sort(F.coalesce(starts, doc["boundaries"], F.from_json(value, "array<double>"), F.array().cast("array<double>")))
    known = F.col(duration) if duration else F.lit(None).cast("double")
    return texts.select(key, bounds.alias("bounds"), F.coalesce(known, doc["duration"], F.array_max(ends), F.array_max(bounds), F.lit(0.0)).alias("duration"))


def asr_turns(raw: DataFrame, key: str = "v", value: str = "value") -> DataFrame:
    """Raw recogniser results to turns: words by start time (the last wins), in the order of each speaker segment.

    Results without speaker segments are one turn of speaker ``spk_0`` with the whole transcript.
    """
    r = raw.select(key, F.from_json(value, ASR)["results"].alias("r"))
    words = r.select(key, F.posexplode("r.items").alias("pos", "i")).filter(F.col("i.start_time").isNotNull())
    words = words.groupBy(key, F.col("i.start_time").alias("at")).agg(F.max_by(F.get(F.col("i.alternatives"), F.lit(0))["content"], "pos").alias("word"))
    spoken = r.select(key, F.posexplode("r.speaker_labels.segments").alias("ord", "s"))
    parts = spoken.select(key, "ord", F.col("s.speaker_label").alias("speaker"), F.expr("try_cast(s.start_time as double)").alias("start"), F.expr("try_cast(s.end_time as double)").alias("end"), F.posexplode_outer("s.items").alias("pos", "i"))
    joined = parts.withColumn("at", F.col("i.start_time")).join(words, [key, "at"], "left").groupBy(key, "ord", "speaker", "start", "end")
    said = joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda x: x["word"]), " ").alias("text")).filter(F.trim("text") != "")
    diarized = said.select(key, F.col("ord").cast("long"), "speaker", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "text")
    plain = r.filter(F.coalesce(F.size("r.speaker_labels.segments"), F.lit(0)) <= 0)
    whole = F.get(F.col("r.transcripts"), F.lit(0))["transcript"]
    last = F.array_max(F.transform("r.items", lambda i: i["end_time"].try_cast("double")))
    single = plain.select(key, F.lit(0).cast("long").alias("ord"), F.lit("spk_0").alias("speaker"), F.lit(0.0).alias("start"), F.round(F.coalesce(last, F.lit(0.0)), 2).alias("end"), whole.alias("text")).filter(F.trim("text") != "")
    return diarized.unionByName(single)


def clock(t: F.Column) -> F.Column:
    """A time as HH:MM:SS.mmm."""
    whole = F.floor(t)
    return F.format_string("%02d:%02d:%06.3f", F.floor(whole / 3600), F.floor((whole % 3600) / 60), t - F.floor(t / 60) * 60)


def vtt_text(turns: DataFrame) -> DataFrame:
    """WebVTT text per timeline; cues count from 1, speakers are named unless unknown."""
    order = Window.partitionBy("v").orderBy("start", "ord")
    spoken = F.when((F.coalesce("speaker", F.lit("")) == "") | (F.col("speaker") == "spk_?"), F.col("text")).otherwise(F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"), F.col("text")))
    cue = F.concat_ws("\n", F.col("n").cast("string"), F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end"))), spoken, F.lit(""))
    numbered = turns.withColumn("n", F.row_number().over(order)).withColumn("cue", cue)
    return numbered.groupBy("v").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cue"))), lambda x: x["cue"]), "\n")).alias("vtt"))


def write_json(docs: DataFrame, path: str, columns: list[str]) -> None:
    """Documents as JSON lines."""
    docs.select(F.to_json(F.struct(*columns)).alias("value")).write.text(path)


def review_markers(proposals: DataFrame) -> DataFrame:
    """Text of the marker of every proposal that needs a review."""
    note = F.concat_ws("\n", F.lit("NEEDS_REVIEW"), F.format_string("content %.2f-%.2f of %.2f", "content_start", "content_end", "duration"))
    return proposals.filter("status = 'NEEDS_REVIEW'").select("v", note.alias("value"))


def template(segments: DataFrame) -> DataFrame:
    """A prediction's rows as a template for a gold timeline."""
    return segments.select("v", "start", "end", F.coalesce("title", F.lit("")).alias("title"))
