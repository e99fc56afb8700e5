"""Aggregations over timelines: hosts, roles, guests, notes, program signals, corpus roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.joins import overlap_join, right_side


def detect_host(turns: DataFrame, bins: int = 10) -> DataFrame:
    """v, host: the speaker with the largest turns times distinct time bins; ties by turns, then by first appearance."""
    whole = Window.partitionBy("v")
    span = turns.withColumns({"t0": F.min("start").over(whole), "t1": F.max("end").over(whole)})
    bin_ = F.least(F.floor(F.lit(bins) * (F.col("start") - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(0.01))), F.lit(bins - 1))
    per = span.withColumn("bin", bin_).groupBy("v", "speaker").agg(F.count("*").alias("n"), F.count_distinct("bin").alias("b"), F.min("ord").alias("first"))
    return per.groupBy("v").agg(F.min_by("speaker", F.struct(-(F.col("n") * F.col("b")), -F.col("n"), "first")).alias("host"))


def speech_by_speaker(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """v, ord, speaker, us, first: microseconds of each speaker within each span."""
    j = overlap_join(spans.select("v", "ord", "start", "end"), right_side(turns, "speaker"))
    return j.groupBy("v", "ord", F.col("r_speaker").alias("speaker")).agg(F.sum(F.round(F.col("overlap") * 1e6).cast("long")).alias("us"), F.min("r_ord").alias("first"))


def dominant_role(spans: DataFrame, turns: DataFrame, hosts: DataFrame, least: float = 6.0) -> DataFrame:
    """v, ord, role: ``guest`` if one speaks for ``least`` seconds and 40 % of the host's time."""
    s = speech_by_speaker(spans, turns).join(hosts, "v", "left")
    guest = F.coalesce(F.max(F.when(~F.col("speaker").eqNullSafe(F.col("host")), F.col("us"))), F.lit(0))
    host = F.coalesce(F.max(F.when(F.col("speaker").eqNullSafe(F.col("host")), F.col("us"))), F.lit(0))
    roles = s.groupBy("v", "ord").agg(F.when(guest >= F.greatest(F.lit(least * 1e6), 0.4 * host), "guest").otherwise("host").alias("role"))
    return spans.select("v", "ord").join(roles, ["v", "ord"], "left").select("v", "ord", F.coalesce("role", F.lit("host")).alias("role"))


def segment_guests(spans: DataFrame, turns: DataFrame, hosts: DataFrame, least: float = 1.5) -> DataFrame:
    """v, ord, guests: non-hosts with ``least`` seconds, first heard first."""
    s = speech_by_speaker(spans, turns).join(hosts, "v", "left").filter((F.col("us") >= least * 1e6) & ~F.col("speaker").eqNullSafe(F.col("host")))
    g = s.groupBy("v", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"]).alias("guests"))
    return spans.select("v", "ord").join(g, ["v", "ord"], "left").select("v", "ord", F.coalesce("guests", F.array().cast("array<string>")).alias("guests"))


def top_notes(notes: DataFrame, k: int = 2) -> DataFrame:
    """v, notes: the ``k`` most frequent labels of (v, ord, label), ties by first seen, joined."""
    per = notes.groupBy("v", "label").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("v").orderBy(F.desc("n"), "first")
    top = per.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), "; ").alias("notes"))


def program_signals(programs: DataFrame, segments: DataFrame, chars: int = 1200) -> DataFrame:
    """v, program_index, cards, intro, closing, outline of each program from its segments (v, ord, program_index, type, title, caption, transcript, card)."""
    up, down = Window.partitionBy("v", "program_index").orderBy("ord"), Window.partitionBy("v", "program_index").orderBy(F.desc("ord"))
    s = segments.withColumns({"a": F.row_number().over(up), "z": F.row_number().over(down)})
    listed = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", value.alias("x"))))), lambda x: x["x"])
    g = s.groupBy("v", "program_index").agg(
        listed(F.col("card"), F.col("caption")).alias("cards"), F.substring(F.array_join(listed(F.col("a") <= 2, F.col("transcript")), " "), 1, chars).alias("intro"),
        F.substring(F.array_join(listed(F.col("z") <= 2, F.col("transcript")), " "), 1, chars).alias("closing"), listed(F.lit(True), F.concat_ws(": ", "type", "title")).alias("outline"),
    )
    return programs.join(g, ["v", "program_index"], "left")


def rollup(per_video: DataFrame) -> DataFrame:
    """Per tolerance over a corpus: pooled tp, fp, fn with micro P/R/F1, and mean pk and windowdiff."""
    g = per_video.groupBy("tol").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("pk").alias("pk"), F.avg("windowdiff").alias("windowdiff"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return g.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def report_lines(scores: DataFrame) -> DataFrame:
    """A text line per scored row (name, precision, recall, f1)."""
    return scores.select(F.format_string("%-24s P=%.3f R=%.3f F1=%.3f", "name", "precision", "recall", "f1").alias("line"))
