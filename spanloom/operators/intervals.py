"""Interval-set operators: merge, complement, clip, subtract, points to spans, dead-space windows and spans.

All work on tables (v, ord, start, end, ...) and exchange rows on the timeline key only.  Every order has
``ord`` as its last key, so that ties are settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import DEFAULT, Config

ANCHORS = ("black", "white", "bars", "snow")
SPANS = "array<struct<start:double,end:double>>"


def islands(df: DataFrame, gap: float, keys: list[str], start: str = "start", end: str = "end", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Adds ``island``: a row joins the one before if its start is within ``gap`` (inclusive) of the running end."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_intervals(df: DataFrame, gap: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Merged spans: keys, start, end, n."""
    keys = keys or ["v"]
    return islands(df, gap, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def merge_salted(df: DataFrame, gap: float, bucket: float) -> DataFrame:
    """``merge_intervals`` by v for timelines too long for one task: first within time buckets, then over the few spans left."""
    cut = df.withColumn("_b", F.floor(F.col("start") / bucket))
    first = merge_intervals(cut, gap, ["v", "_b"]).withColumnRenamed("n", "part").withColumn("ord", F.col("_b"))
    return islands(first, gap, ["v"]).groupBy("v", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("part").alias("n")).drop("island")


def covered_seconds(merged: DataFrame) -> DataFrame:
    """Seconds that disjoint spans cover, per timeline (summed on whole microseconds)."""
    micros = F.round((F.col("end") - F.col("start")) * 1e6).cast("long")
    return merged.groupBy("v").agg(F.count("*").alias("n_spans"), (F.sum(micros) / F.lit(1e6)).alias("covered_s"))


def complement(merged: DataFrame, durations: DataFrame, slack: float = 0.1) -> DataFrame:
    """Gaps of disjoint spans in [0, duration] that are longer than ``slack``: v, start, end."""
    w = Window.partitionBy("v").orderBy("start", "end")
    inner = merged.select("v", F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("a"), F.col("start").alias("b"))
    tail = durations.join(merged.groupBy("v").agg(F.max_by("end", F.struct("start", "end")).alias("last")), "v", "left").select("v", F.coalesce("last", F.lit(0.0)).alias("a"), F.col("duration").alias("b"))
    return inner.filter(F.col("b") > F.col("a") + slack).unionByName(tail.filter(F.col("a") < F.col("b") - slack)).select("v", F.col("a").alias("start"), F.col("b").alias("end"))


def clip(df: DataFrame, lo: Column, hi: Column, least: float = 0.05) -> DataFrame:
    """Spans cut to [lo, hi]; what is ``least`` long or less is dropped."""
    cut = df.withColumn("start", F.greatest("start", lo)).withColumn("end", F.least("end", hi))
    return cut.filter(F.col("end") - F.col("start") > least)


def subtract(df: DataFrame, holes: DataFrame, least_hole: float = 0.5, least: float = 0.05) -> DataFrame:
    """Spans (v, ord, start, end) without holes (v, start, end): v, ord, start, end of the pieces left."""
    merged = merge_intervals(holes.filter(F.col("end") - F.col("start") >= least_hole).withColumn("ord", F.lit(0)), 0.0)
    merged = merged.select("v", F.col("start").alias("hs"), F.col("end").alias("he"))
    hit = df.join(merged, (df["v"] == merged["v"]) & (merged["hs"] < df["end"]) & (merged["he"] > df["start"]), "left").select(df["v"], "ord", "start", "end", "hs", "he")
    w = Window.partitionBy("v", "ord", "start", "end").orderBy("hs")
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    before = piece(F.greatest(F.coalesce(F.lag("he").over(w), F.col("start")), F.col("start")), F.coalesce("hs", "end"))
    after = F.when(F.col("hs").isNotNull() & F.lead("hs").over(w).isNull(), piece(F.col("he"), F.col("end")))
    pieces = hit.select("v", "ord", before.alias("before"), after.alias("after")).select("v", "ord", F.explode(F.array("before", "after")).alias("x"))
    return pieces.filter(F.col("x.end") - F.col("x.start") > least).select("v", "ord", "x.start", "x.end")


def points_to_intervals(points: DataFrame, step: float = 1.0, least: float = 2.0) -> DataFrame:
    """Positive samples (v, t) to spans: neighbours within 2 steps join, an end lasts a step; shorter than ``least`` go."""
    w = Window.partitionBy("v").orderBy("t")
    each = points.select("v", "t").distinct().withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= 2 * step, 0).otherwise(1))
    runs = each.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("v", "island")
    spans = runs.agg(F.min("t").alias("start"), (F.max("t") + step).alias("end"))
    return spans.filter(F.col("end") - F.col("start") >= least).drop("island")


def head_leader_end(regions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """v, leader_end: where a leading chain of visual regions ends; 0 if it is shorter than ``head_min``."""
    w = Window.partitionBy("v").orderBy("start", "end", "ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0.0))
    lead = regions.filter(F.col("kind").isin(*ANCHORS)).withColumn("reach", reach)
    broken = (F.col("start") > F.greatest(F.lit(cfg.head_min), F.col("reach")) + cfg.head_gap) | (F.col("reach") >= cfg.head_max)
    kept = lead.withColumn("broken", F.sum(broken.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("broken = 0")
    ends = kept.groupBy("v").agg(F.greatest(F.max("end"), F.lit(0.0)).alias("e"))
    return regions.select("v").distinct().join(ends, "v", "left").select("v", F.when(F.col("e") >= cfg.head_min, F.col("e")).otherwise(F.lit(0.0)).alias("leader_end"))


def runs(regions: DataFrame, gap: float) -> DataFrame:
    """Merged runs with their children by kind (freeze is not kept): v, run, start, end, black .. snow."""
    kids = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end")))).cast(SPANS).alias(k) for k in ("black", "white", "silence", "bars", "snow")]
    return islands(regions, gap, ["v"]).groupBy("v", F.col("island").alias("run")).agg(F.min("start").alias("start"), F.max("end").alias("end"), *kids)


def total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + (x["end"] - x["start"]))


def coalesce_spans(spans: Column, gap: float = 5.0) -> Column:
    """Sorted spans of an array joined where the gap is at most ``gap``."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(SPANS),
        lambda a, x: F.when((F.size(a) > 0) & (x["start"] - F.try_element_at(a, F.lit(-1))["end"] <= gap), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )


def overlap_seconds(spans: Column, start: Column, end: Column) -> Column:
    """Seconds of an array's spans within [start, end]."""
    return F.aggregate(spans, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), F.least(end, x["end"]) - F.greatest(start, x["start"])))


def over_speech(speech: Column, start: Column, end: Column, least: float = 2.0) -> Column:
    return F.exists(speech, lambda w: F.least(end, w["end"]) - F.greatest(start, w["start"]) >= least)


def classified_runs(regions: DataFrame, speech: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Runs with the decision of the table (``drop``, ``parts`` or ``whole``) and the kind of a whole one."""
    r = runs(regions, cfg.merge_gap)
    if speech is None:
        r = r.withColumn("speech", F.array().cast(SPANS))
    else:
        windows = speech.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).cast(SPANS).alias("speech"))
        r = r.join(windows, "v", "left").withColumn("speech", F.coalesce("speech", F.array().cast(SPANS)))
    dur = F.col("end") - F.col("start")
    some = lambda k: F.size(k) > 0
    visual = total(F.col("black")) + total(F.col("white")) + total(F.col("bars")) + total(F.col("snow"))
    floor = F.when((some("bars") | some("snow")) & ~(some("black") | some("white")), min(cfg.visual_min_dead, cfg.min_dead)).otherwise(cfg.min_dead)
    if cfg.mode != "black":
        return r.withColumn("decision", F.when(dur < floor, "drop").otherwise("whole")).withColumn("kind", F.lit("mixed"))
    decision = (
        F.when(dur < floor, "drop")
        .when(~(some("black") | some("white") | some("bars") | some("snow")), "drop")
        .when((dur > cfg.long_run) & (visual / F.nullif(dur, F.lit(0.0)) < cfg.cover), "parts")
        .when(some("black") & over_speech(F.col("speech"), F.col("start"), F.col("end"), cfg.speech_overlap), "parts")
        .when((dur > cfg.very_long_run) & (total(F.col("silence")) / F.nullif(dur, F.lit(0.0)) < cfg.cover), "parts")
        .otherwise("whole")
    )
    kind = F.when(some("bars"), "bars").when(some("snow"), F.when(total(F.col("snow")) >= total(F.col("black")), "snow").otherwise("black")).when(some("white") & ~some("black"), "white").otherwise("black")
    return r.withColumn("decision", decision).withColumn("kind", kind)


def dead_spans(regions: DataFrame, durations: DataFrame, speech: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Dead spans (v, ord, start, end, kind): runs by the table, parts of those split, padded and coalesced in order."""
    r = classified_runs(regions, speech, cfg).filter("decision <> 'drop'")
    immune = {"bars": True, "snow": True, "black": False, "white": False}

    def parts(kind: str, rank: int) -> Column:
        least = min(cfg.visual_min_dead, cfg.min_dead) if immune[kind] else cfg.min_dead

        def keep(x: Column) -> Column:
            long = x["end"] - x["start"] >= least
            if immune[kind]:
                return long
            silent = (x["end"] - x["start"] >= cfg.sustained) & (overlap_seconds(F.col("silence"), x["start"], x["end"]) / F.nullif(x["end"] - x["start"], F.lit(0.0)) >= cfg.sustained_cover)
            return long & (~over_speech(F.col("speech"), x["start"], x["end"], cfg.speech_overlap) | F.coalesce(silent, F.lit(False)))

        return F.transform(F.filter(coalesce_spans(F.col(kind), cfg.coalesce_gap), keep), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))

    whole = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("kind").alias("kind"), F.lit(0).alias("rank")))
    emitted = F.when(F.col("decision") == "whole", whole).otherwise(F.concat(*(parts(k, i) for i, k in enumerate(immune))))
    each = r.select("v", "run", F.posexplode(emitted).alias("pos", "s")).join(durations, "v", "left")
    padded = F.col("s.kind").isin("bars", "snow")
    lo = F.when(padded, F.greatest(F.lit(0.0), F.col("s.start") - cfg.edge_pad)).otherwise(F.col("s.start"))
    hi = F.when(padded, F.least(F.coalesce("duration", F.col("s.end") + cfg.edge_pad), F.col("s.end") + cfg.edge_pad)).otherwise(F.col("s.end"))
    order = F.struct(F.col("s.start").alias("at"), "run", "pos", lo.alias("start"), hi.alias("end"), F.col("s.kind").alias("kind"))
    gap, item = max(cfg.merge_gap, cfg.coalesce_gap), "array<struct<start:double,end:double,kind:string>>"

    def fold(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.when(x["end"] - x["start"] > last["end"] - last["start"], x["kind"]).otherwise(last["kind"]).alias("kind"))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        return F.when((F.size(a) > 0) & (x["start"] - last["end"] <= gap), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(a, F.array(own)))

    spans = each.groupBy("v").agg(F.aggregate(F.array_sort(F.collect_list(order)), F.array().cast(item), fold).alias("spans"))
    return spans.select("v", F.posexplode("spans").alias("ord", "s")).select("v", F.col("ord").cast("long"), "s.start", "s.end", "s.kind")


def full_analysis(dead: DataFrame, durations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per timeline: dead spans after short content was absorbed (first touching span, in order), content spans and status."""
    item = "array<struct<start:double,end:double,kind:string>>"
    packed = dead.groupBy("v").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "kind"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).cast(item).alias("dead"))
    base = durations.join(packed, "v", "left").withColumn("dead", F.coalesce("dead", F.array().cast(item)))
    before = F.transform("dead", lambda x, i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.get(F.col("dead"), i - 1)["end"]).alias("start"), x["start"].alias("end")))
    inner = F.filter(before, lambda x: x["end"] > x["start"] + 0.1)
    last = F.coalesce(F.try_element_at("dead", F.lit(-1))["end"], F.lit(0.0))
    tail = F.when(last < F.col("duration") - 0.1, F.array(F.struct(last.alias("start"), F.col("duration").alias("end")))).otherwise(F.array().cast(SPANS))
    cut = base.withColumn("gaps", F.concat(inner, tail)).withColumn("gaps", F.when((F.size("gaps") == 0) & (F.size("dead") == 0), F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").alias("end")))).otherwise(F.col("gaps")))
    short = F.filter("gaps", lambda x: x["end"] - x["start"] < cfg.min_content)

    def absorb(a: Column, g: Column) -> Column:
        touches = lambda d: (F.abs(d["end"] - g["start"]) < 0.5) | (F.abs(d["start"] - g["end"]) < 0.5)
        first = F.array_position(F.transform(a, touches), True) - 1
        return F.transform(a, lambda d, i: F.when(i != first, d).when(F.abs(d["end"] - g["start"]) < 0.5, F.struct(d["start"].alias("start"), g["end"].alias("end"), d["kind"].alias("kind"))).otherwise(F.struct(g["start"].alias("start"), d["end"].alias("end"), d["kind"].alias("kind"))))

    out = cut.withColumn("dead", F.aggregate(short, F.col("dead"), absorb)).withColumn("content", F.filter("gaps", lambda x: x["end"] - x["start"] >= cfg.min_content)).drop("gaps")
    held = total(F.col("content"))
    return out.withColumn("status", F.when((held <= 0) | (held / F.nullif("duration", F.lit(0.0)) < 0.1), "NEEDS_REVIEW").otherwise("OK"))


def head_tail_window(regions: DataFrame, durations: DataFrame, gap: float = 0.5, cfg: Config = DEFAULT) -> DataFrame:
    """Head and tail trim: v, duration, content_start, content_end, status; silence that fills 98 % of a file is ignored."""
    silent = regions.filter("kind = 'silence'").groupBy("v").agg(F.sum(F.col("end") - F.col("start")).alias("silent"))
    noisy = regions.join(durations, "v").join(silent, "v", "left").filter((F.col("kind") != "silence") | (F.coalesce("silent", F.lit(0.0)) < 0.98 * F.col("duration"))).select("v", "ord", "start", "end", "kind")
    both, plain = runs(noisy, gap), runs(noisy.filter("kind <> 'freeze'"), gap)
    head = both.filter(F.col("start") <= cfg.edge_tol).groupBy("v").agg(F.min_by(F.struct("*"), "run").alias("h"))
    tail = plain.join(durations, "v").filter(F.col("end") >= F.col("duration") - cfg.edge_tol).groupBy("v").agg(F.max_by(F.struct("start", "end", "black", "white", "snow"), "run").alias("t"))
    ends = F.array_max(F.concat(*(F.transform(f"h.{k}", lambda x: x["end"]) for k in ("black", "white", "bars", "snow"))))
    starts = F.array_min(F.concat(*(F.transform(f"t.{k}", lambda x: x["start"]) for k in ("black", "white", "snow"))))
    whole = F.coalesce(F.col("h.end") >= F.col("duration") - cfg.edge_tol, F.lit(False))
    lo = F.coalesce(ends if cfg.mode == "black" else F.col("h.end"), F.lit(0.0))
    hi = F.coalesce(starts if cfg.mode == "black" else F.col("t.start"), F.col("duration"))
    cut = durations.join(head, "v", "left").join(tail, "v", "left").select("v", "duration", F.when(whole, 0.0).otherwise(lo).alias("content_start"), F.when(whole, F.col("duration")).otherwise(hi).alias("content_end"), whole.alias("whole"))
    kept = F.col("content_end") - F.col("content_start")
    status = F.when(F.col("whole") | (kept <= 0) | (kept / F.nullif("duration", F.lit(0.0)) < cfg.min_keep), "NEEDS_REVIEW").otherwise("OK")
    return cut.withColumn("status", status).drop("whole")


def proposal_columns(df: DataFrame) -> DataFrame:
    """A proposal's derived columns: kept, kept_pct, head_trim, tail_trim."""
    kept = F.col("content_end") - F.col("content_start")
    return df.withColumns({"kept": kept, "kept_pct": F.coalesce(F.try_divide(100 * kept, "duration"), F.lit(0.0)), "head_trim": F.col("content_start"), "tail_trim": F.col("duration") - F.col("content_end")})


def absorb_short(shots: DataFrame, least: float) -> DataFrame:
    """Shots shorter than ``least`` extend the one before: v, start, end."""
    w = Window.partitionBy("v").orderBy("start", "ord")
    new = (F.row_number().over(w) == 1) | (F.col("end") - F.col("start") >= least)
    each = shots.withColumn("_n", new.cast("int")).withColumn("piece", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("v", "piece").agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "ord")).alias("end")).drop("piece")
