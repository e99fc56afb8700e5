"""Composed plans: dead-space analysis and the model-free segmentation of recordings with speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import DEFAULT, Config
from spanloom.functions.scalars import normalize_category
from spanloom.operators import aggs, folds, intervals, joins, sequences
from spanloom.staging import staged


def speech_windows(turns: DataFrame, gap: float = 5.0) -> DataFrame:
    return intervals.merge_intervals(turns, gap)


def dead_and_content(regions: DataFrame, durations: DataFrame, turns: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Per timeline: dead and content spans and status; speech vetoes."""
    speech = speech_windows(turns) if turns is not None else None
    return intervals.full_analysis(intervals.dead_spans(regions, durations, speech, cfg), durations, cfg)


def fuse(shots: DataFrame, turns: DataFrame, splices: DataFrame) -> DataFrame:
    """Stories of timelines with speech: shots (v, ord, start, end), turns and splices (v, start, end) to v, ord, start, end, label, name, speakers."""
    turns, shots, splices = staged(turns, "turns"), staged(shots, "shots"), staged(splices, "splices")
    hosts = staged(aggs.detect_host(turns), "hosts")
    fused = joins.attach(shots, turns)
    edges = splices.select("v", F.explode(F.array("start", "end")).alias("t"))
    cuts = sequences.lexical_boundaries(turns).unionByName(sequences.pause_boundaries(turns)).unionByName(edges).distinct()
    pieces = staged(joins.split_on_topics(sequences.merge_by_speaker(fused, hosts), cuts, shots), "pieces")
    said = joins.segment_text(pieces, turns)
    rich = said.join(aggs.dominant_role(pieces, turns, hosts), ["v", "ord"]).join(aggs.segment_guests(pieces, turns, hosts), ["v", "ord"])
    labelled = rich.withColumns({"label": normalize_category(F.lit(""), F.col("transcript")), "name": F.substring("transcript", 1, 40)})
    return folds.coalesce_conversation(labelled.select("v", "ord", "start", "end", "role", "guests", "label", "name", "speakers"), splices)


def timeline(stories: DataFrame, dead: DataFrame, turns: DataFrame, durations: DataFrame) -> DataFrame:
    """Timeline rows (v, ord, start, end, type, title): stories around dead spans of half a second or more, blank pieces dead, the ends snapped."""
    kind = F.create_map(*(F.lit(x) for p in (("bars", "Color bars (auto-detected)"), ("snow", "Video static/snow (auto-detected)"), ("black", "Black gap (auto-detected)"), ("white", "White gap (auto-detected)")) for x in p))
    stories, dead, turns = staged(stories, "stories"), staged(dead, "dead"), staged(turns, "turns")
    holes = dead.filter(F.col("end") - F.col("start") >= 0.5)
    pieces = intervals.subtract(stories.select("v", "ord", "start", "end"), holes)
    uncut = stories.select("v", "ord", F.col("start").alias("s0"), F.col("end").alias("e0"), "label", "name")
    said = joins.segment_text(pieces, turns).join(uncut, ["v", "ord"])
    blank = (F.trim("transcript") == "") & ((F.col("start") != F.col("s0")) | (F.col("end") != F.col("e0")))
    content = said.select("v", "start", "end", F.when(blank, "D").otherwise(F.col("label")).alias("type"), F.when(blank, "Dead space (auto-detected)").otherwise(F.col("name")).alias("title"))
    marks = holes.select("v", "start", "end", F.lit("D").alias("type"), F.coalesce(kind[F.col("kind")], F.lit("Dead space (auto-detected)")).alias("title"))
    rows = content.unionByName(marks).filter(F.col("end") - F.col("start") > 0.05)
    w = F.struct("start", "end", "type", "title")
    packed = rows.groupBy("v").agg(F.array_sort(F.collect_list(w)).alias("s")).join(durations, "v")
    each = packed.select("v", "duration", F.size("s").alias("n"), F.posexplode("s").alias("ord", "s"))
    return each.select("v", F.col("ord").cast("long"), F.when(F.col("ord") == 0, 0.0).otherwise(F.round("s.start", 2)).alias("start"), F.when(F.col("ord") == F.col("n") - 1, F.round("duration", 2)).otherwise(F.round("s.end", 2)).alias("end"), "s.type", "s.title")


def grid_segmentation(samples: DataFrame, ends: DataFrame, targets: list[str], most: int = 0, least: float = 0.0) -> DataFrame:
    """Label samples (v, ord, t, label) to a cleaned timeline: confirm, smooth, merge, consolidate."""
    clean = sequences.smooth_labels(sequences.confirm_targets(samples, targets))
    return folds.consolidate_segments(sequences.merge_labels(clean, ends), most, least)
