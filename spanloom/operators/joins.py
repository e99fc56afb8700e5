"""Interval, existence, as-of and nearest joins; every join has the timeline key as an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", least: float | None = None, bucket: float | None = None) -> DataFrame:
    """left (v, ord, start, end, ...) with right (v, r_ord, r_start, r_end, ...) where they overlap: adds ``overlap``.

    Overlap is strict (> 0), or ``least`` inclusive.  ``bucket`` spreads a long timeline over time buckets: both
    sides go to each bucket they touch and a pair is kept in its first common one, so none is repeated.
    """
    over = F.least("end", "r_end") - F.greatest("start", "r_start")
    hit = over > 0 if least is None else over >= least
    if bucket is None:
        out = left.join(right.withColumnRenamed("v", "r_v"), (F.col("v") == F.col("r_v")) & hit, how)
        return out.drop("r_v").withColumn("overlap", over)
    if how != "inner":
        raise ValueError("bucketed joins are inner")
    at = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    a, b = left.withColumn("_b", at("start", "end")), right.withColumn("_b", at("r_start", "r_end"))
    first = F.col("_b") == F.floor(F.greatest("start", "r_start") / bucket)
    return a.join(b, ["v", "_b"]).filter(hit & first).drop("_b").withColumn("overlap", over)


def right_side(df: DataFrame, *extra: str) -> DataFrame:
    """A table's columns under the names of a join's right side."""
    return df.select("v", F.col("ord").alias("r_ord"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), *(F.col(c).alias(f"r_{c}") for c in extra))


def attach(shots: DataFrame, turns: DataFrame) -> DataFrame:
    """Each shot with its turns: v, ord, start, end, speakers (first heard first), speech_frac, text."""
    j = overlap_join(shots.select("v", "ord", "start", "end"), right_side(turns, "speaker", "text"), "left")
    g = j.groupBy("v", "ord", "start", "end").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("overlap").isNotNull(), F.struct("r_ord", "r_speaker")))), lambda x: x["r_speaker"])).alias("speakers"),
        F.sum(F.when(F.col("overlap").isNotNull(), F.round(F.col("overlap") * 1e6).cast("long"))).alias("covered"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("overlap").isNotNull(), F.struct("r_start", "r_speaker", "r_text")))), lambda x: x["r_text"]), " ").alias("text"),
    )
    dur = F.round((F.col("end") - F.col("start")) * 1e6).cast("long")
    frac = F.coalesce(F.round(F.least(F.try_divide(F.coalesce("covered", F.lit(0)), dur), F.lit(1.0)), 2), F.lit(0.0))
    return g.select("v", "ord", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "speakers", frac.alias("speech_frac"), F.trim("text").alias("text"))


def segment_text(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """Each span with its transcript in turn order and its speakers: v, ord, start, end, transcript, speakers."""
    j = overlap_join(spans.select("v", "ord", "start", "end"), right_side(turns, "speaker", "text"), "left")
    rows = F.array_sort(F.collect_list(F.when(F.col("overlap").isNotNull(), F.struct("r_ord", "r_speaker", "r_text"))))
    g = j.groupBy("v", "ord", "start", "end").agg(rows.alias("x"))
    return g.select("v", "ord", "start", "end", F.trim(F.array_join(F.transform("x", lambda x: x["r_text"]), " ")).alias("transcript"), F.array_distinct(F.transform("x", lambda x: x["r_speaker"])).alias("speakers"))


def overlaps_any(spans: DataFrame, windows: DataFrame, least: float = 2.0) -> DataFrame:
    """Spans that share ``least`` seconds with any window."""
    w = windows.select(F.col("v").alias("w_v"), F.col("start").alias("ws"), F.col("end").alias("we"))
    return spans.join(w, (F.col("v") == F.col("w_v")) & (F.least("end", "we") - F.greatest("start", "ws") >= least), "left_semi")


def span_in_gap(a_end: Column, b_start: Column, spans: Column, tol: float) -> Column:
    """Whether a span of an array touches the gap, widened by ``tol``."""
    return F.exists(spans, lambda s: (s["start"] <= F.greatest(a_end, b_start) + tol) & (s["end"] >= F.least(a_end, b_start) - tol))


def overlap_total(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seconds that two sets of spans share, per timeline."""
    j = overlap_join(a.select("v", F.col("start").alias("start"), "end"), b.select("v", F.col("start").alias("r_start"), F.col("end").alias("r_end")))
    return j.groupBy("v").agg((F.sum(F.round(F.col("overlap") * 1e6).cast("long")) / 1e6).alias("shared_s"))


def within(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """Points of ``a`` (v, t) that have one of ``b`` within ``tol``: those whose nearest is."""
    return nearest(a.select("v", "t"), b).filter(F.abs(F.col("t") - F.col("near")) <= tol).select("v", "t")


def speaker_change(points: DataFrame, turns: DataFrame, tol: float = 2.0) -> DataFrame:
    """v, t, before, after, changed: the last speaker who ended by t + tol and the first who starts from t - tol on.

    Points and turns are one table in the order of time, so that a timeline is sorted twice and no pairs are made.
    """
    said = F.struct("start", "ord", "speaker")
    rows = turns.select("v", F.lit(None).cast("double").alias("t"), F.col("end").alias("k1"), F.col("start").alias("k2"), said.alias("said"), F.lit(0).alias("side"))
    rows = rows.unionByName(points.select("v", "t", (F.col("t") + tol).alias("k1"), (F.col("t") - tol).alias("k2"), F.lit(None).cast(rows.schema["said"].dataType).alias("said"), F.lit(1).alias("side")))
    ended = Window.partitionBy("v").orderBy("k1", "side").rowsBetween(Window.unboundedPreceding, 0)
    starts = Window.partitionBy("v").orderBy("k2", F.desc("side")).rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumns({"before": F.max("said").over(ended)["speaker"], "after": F.min("said").over(starts)["speaker"]}).filter("side = 1")
    return out.select("v", "t", "before", "after", F.coalesce(F.col("before") != F.col("after"), F.lit(False)).alias("changed"))


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """v, t, near: the nearest target (v, t) of the timeline, the earlier on a tie; one sorted pass."""
    rows = targets.select("v", F.col("t").alias("k"), F.col("t").alias("target"), F.lit(0).alias("side"))
    rows = rows.unionByName(points.select("v", F.col("t").alias("k"), F.lit(None).cast("double").alias("target"), F.lit(1).alias("side")))
    w = Window.partitionBy("v").orderBy("k", "side")
    low, high = F.last("target", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("target", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = rows.withColumns({"low": low, "high": high}).filter("side = 1")
    near = F.when(F.col("low").isNull() | (F.col("high") - F.col("k") < F.col("k") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return out.select("v", F.col("k").alias("t"), near.alias("near"))


def stitch(candidates: DataFrame, turns: DataFrame, tol: float = 12.0) -> DataFrame:
    """Boundaries (v, t): candidates clustered within ``tol``, the median snapped to a turn's start, thinned to ``tol`` apart."""
    w = Window.partitionBy("v").orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) <= tol, 0).otherwise(1)
    c = candidates.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    mid = c.groupBy("v", "cluster").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("v", F.element_at("ts", (F.floor(F.size("ts") / 2) + 1).cast("int")).alias("t"))
    snapped = nearest(mid, turns.select("v", F.col("start").alias("t")).distinct()).select("v", F.coalesce("near", "t").alias("t"))
    kept = snapped.groupBy("v").agg(
        F.aggregate(F.array_sort(F.collect_list("t")), F.array().cast("array<double>"), lambda a, x: F.when((F.size(a) == 0) | (x - F.try_element_at(a, F.lit(-1)) > tol), F.concat(a, F.array(x))).otherwise(a)).alias("ts")
    )
    return kept.select("v", F.explode("ts").alias("t")).select("v", F.round("t", 2).alias("t"))


def split_on_topics(segments: DataFrame, boundaries: DataFrame, shots: DataFrame, least: float = 8.0, snap: float = 3.0) -> DataFrame:
    """Segments (v, ord, start, end) split at boundaries (v, t) well inside, on a near shot start: v, ord, start, end.

    A piece shorter than ``least`` extends the row before it, also one that is a whole segment.
    """
    b = boundaries.select(F.col("v").alias("b_v"), "t")
    cut = segments.join(b, (F.col("v") == F.col("b_v")) & (F.col("t") >= F.col("start") + least) & (F.col("t") <= F.col("end") - least)).select("v", "ord", "start", "end", "t")
    s = shots.select(F.col("v").alias("s_v"), F.col("start").alias("ss")).distinct()
    near = cut.join(s, (F.col("v") == F.col("s_v")) & (F.col("ss") > F.col("start")) & (F.col("ss") < F.col("end")) & (F.abs(F.col("ss") - F.col("t")) <= snap), "left")
    at = near.groupBy("v", "ord", "t").agg(F.min_by("ss", F.struct(F.abs(F.col("ss") - F.col("t")), "ss")).alias("ss")).select("v", "ord", F.round(F.coalesce("ss", "t"), 2).alias("c"))
    cuts = at.groupBy("v", "ord").agg(F.array_sort(F.collect_set("c")).alias("cuts"))
    points = segments.join(cuts, ["v", "ord"], "left").withColumn("p", F.concat(F.array("start"), F.coalesce("cuts", F.array().cast("array<double>")), F.array("end")))
    each = points.select("v", "ord", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", i + 1).alias("b")))).alias("k", "x")).select("v", "ord", "k", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    w = Window.partitionBy("v").orderBy("ord", "k")
    own = each.withColumn("_n", ((F.row_number().over(w) == 1) | (F.col("b") - F.col("a") >= least)).cast("int")).withColumn("piece", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = own.groupBy("v", "piece").agg(F.min_by("a", F.struct("ord", "k")).alias("start"), F.max_by("b", F.struct("ord", "k")).alias("end"))
    return out.select("v", (F.col("piece") - 1).alias("ord"), "start", "end")
