"""Window and ordered-sequence operators: speakers, pauses, labels, programs, cues, lexical cohesion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalars import near, title_card
from spanloom.operators.joins import span_in_gap, speaker_change

# Words without topic, which lexical cohesion leaves out.
STOP_WORDS = (
    "the a an and or but of to in on at for with as is are was were be been being it its "
    "this that these those i you he she they we me my your his her their our us him them "
    "there here what which who how when where why not no yes do does did have has had will "
    "would can could should may might must so if then out up down into about uh um okay ok "
    "well like know get got go going come one two"
)


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def merge_same_speaker(turns: DataFrame, gap: float = 3.0) -> DataFrame:
    """Consecutive turns of a speaker less than ``gap`` apart (strict) as one; its end is the last turn's."""
    w = Window.partitionBy("v").orderBy("ord")
    joins = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start") - F.lag("end").over(w) < gap)
    t = turns.withColumn("_n", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("_n").over(_running(w)))
    g = t.groupBy("v", "run").agg(F.min("ord").alias("ord"), F.first("speaker").alias("speaker"), F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return g.drop("run")


def merge_by_speaker(shots: DataFrame, hosts: DataFrame, least: float = 0.2) -> DataFrame:
    """Fused shots (v, ord, start, end, speakers, speech_frac) to runs of one signature: v, ord, start, end, role, speakers.

    Shots without speech belong to the run before, leading ones to the run after.
    """
    j = shots.join(hosts, "v", "left")
    guests = F.filter("speakers", lambda x: ~x.eqNullSafe(F.col("host")))
    sig = F.when(F.col("speech_frac") < least, F.lit(None)).when(F.size(guests) > 0, F.concat(F.lit("guest|"), F.array_join(guests, "|"))).otherwise(F.lit("host"))
    w = Window.partitionBy("v").orderBy("ord")
    after = w.rowsBetween(0, Window.unboundedFollowing)
    s = j.withColumn("sig", sig)
    s = s.withColumn("sig", F.coalesce(F.last("sig", ignorenulls=True).over(_running(w)), F.first("sig", ignorenulls=True).over(after), F.lit("nospeech")))
    s = s.withColumn("_n", F.when(F.lag("sig").over(w) == F.col("sig"), 0).otherwise(1)).withColumn("run", F.sum("_n").over(_running(w)))
    g = s.groupBy("v", "run", "sig").agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "speakers"))), lambda x: x["speakers"]))).alias("speakers"))
    return g.select("v", (F.col("run") - 1).alias("ord"), "start", "end", F.when(F.col("sig").startswith("guest|"), "guest").otherwise(F.col("sig")).alias("role"), "speakers")


def pause_boundaries(turns: DataFrame, least: float = 1.5) -> DataFrame:
    """v, t: the middles of silences of ``least`` seconds or more between turns."""
    w = Window.partitionBy("v").orderBy("start", "ord")
    t = turns.withColumn("next", F.lead("start").over(w))
    return t.filter(F.col("next") - F.col("end") >= least).select("v", F.round((F.col("end") + F.col("next")) / 2.0, 2).alias("t"))


def _runs(samples: DataFrame) -> DataFrame:
    w = Window.partitionBy("v").orderBy("ord")
    return samples.withColumn("_n", F.when(F.lag("label").over(w) == F.col("label"), 0).otherwise(1)).withColumn("run", F.sum("_n").over(_running(w))).drop("_n")


def confirm_targets(samples: DataFrame, targets: list[str], least: int = 2) -> DataFrame:
    """Target labels in runs shorter than ``least`` become ``other``."""
    n = F.count("*").over(Window.partitionBy("v", "run"))
    return _runs(samples).withColumn("label", F.when(F.col("label").isin(targets) & (n < least), "other").otherwise(F.col("label"))).drop("run")


def smooth_labels(samples: DataFrame) -> DataFrame:
    """A label between two equal others takes theirs; edges stay, neighbours are the original ones."""
    w = Window.partitionBy("v").orderBy("ord")
    p, n = F.lag("label").over(w), F.lead("label").over(w)
    return samples.withColumn("label", F.when((p == n) & (p != F.col("label")), p).otherwise(F.col("label")))


def merge_labels(samples: DataFrame, ends: DataFrame) -> DataFrame:
    """Samples (v, ord, t, label) to spans of equal labels: v, ord, start, end, label; the last ends at ``end_time``."""
    w = Window.partitionBy("v").orderBy("ord")
    s = _runs(samples.withColumn("next", F.lead("t").over(w))).join(ends, "v", "left")
    g = s.groupBy("v", "run", "label").agg(F.min_by("t", "ord").alias("start"), F.max_by(F.coalesce("next", "end_time"), "ord").alias("end"))
    return g.select("v", (F.col("run") - 1).alias("ord"), "start", "end", "label")


def coalesce_labels(spans: DataFrame) -> DataFrame:
    """Adjacent spans of equal labels as one."""
    s = _runs(spans)
    return s.groupBy("v", "run", "label").agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end")).select("v", (F.col("run") - 1).alias("ord"), "start", "end", "label")


def program_groups(segments: DataFrame, snow: DataFrame, tol: float = 2.0, least: int = 3) -> DataFrame:
    """Content segments (v, ord, start, end, speakers, caption) with program_index; timelines with one program are left out."""
    spans = snow.groupBy("v").agg(F.collect_list(F.struct("start", "end")).alias("snow"))
    w = Window.partitionBy("v").orderBy("ord")
    s = segments.join(spans, "v", "left").withColumns({"p_end": F.lag("end").over(w), "p_speakers": F.lag("speakers").over(w), "n": F.count("*").over(Window.partitionBy("v"))})
    changed = (F.size("p_speakers") > 0) & (F.size("speakers") > 0) & ~F.arrays_overlap("p_speakers", "speakers")
    spliced = span_in_gap(F.col("p_end"), F.col("start"), F.coalesce("snow", F.array().cast("array<struct<start:double,end:double>>")), tol)
    new = F.col("p_end").isNull() | (spliced & (F.coalesce(changed, F.lit(False)) | title_card(F.col("caption"))))
    s = s.withColumn("_n", new.cast("int")).withColumn("program_index", F.sum("_n").over(_running(w)) - 1)
    many = s.withColumn("last", F.max("program_index").over(Window.partitionBy("v"))).filter((F.col("n") >= least) & (F.col("last") > 0))
    return many.select("v", "ord", "start", "end", "program_index")


def programs(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("v", "program_index").agg(F.min_by("start", "ord").alias("program_start"), F.max_by("end", "ord").alias("program_end"))


def boundary_confidence(segments: DataFrame, turns: DataFrame, shots: DataFrame, model: DataFrame, lexical: DataFrame, tol: float = 2.0, pause: float = 0.8) -> DataFrame:
    """v, ord, start, cues, confidence of each segment's start; the first of a timeline is high without cues."""
    points = lambda df, name: df.groupBy("v").agg(F.collect_set("t").alias(name))
    w = Window.partitionBy("v").orderBy("start", "ord")
    gaps = turns.withColumn("next", F.lead("start").over(w)).filter(F.col("next") - F.col("end") >= pause).groupBy("v").agg(F.collect_list(F.struct("end", "next")).alias("gaps"))
    s = segments.select("v", "ord", "start").withColumn("row", F.row_number().over(Window.partitionBy("v").orderBy("ord")))
    s = s.join(points(shots.select("v", F.col("start").alias("t")), "shots"), "v", "left").join(gaps, "v", "left").join(points(model, "model"), "v", "left").join(points(lexical, "lex"), "v", "left")
    change = speaker_change(segments.select("v", F.col("start").alias("t")).distinct(), turns, tol).select("v", F.col("t").alias("start"), "changed")
    s = s.join(change, ["v", "start"], "left")
    none = F.array().cast("array<double>")
    hit = lambda name: near(F.col("start"), F.coalesce(name, none), tol)
    paused = F.coalesce(F.exists("gaps", lambda g: (F.col("start") >= g["end"] - tol) & (F.col("start") <= g["next"] + tol)), F.lit(False))
    cues = F.filter(F.array(F.when(hit("shots"), "shot"), F.when(F.coalesce("changed", F.lit(False)), "speaker"), F.when(paused, "pause"), F.when(hit("lex"), "lexical"), F.when(hit("model"), "llm")), lambda x: x.isNotNull())
    s = s.withColumn("cues", F.when(F.col("row") == 1, F.array().cast("array<string>")).otherwise(cues))
    level = F.when((F.col("row") == 1) | (F.size("cues") >= 3), "high").when(F.size("cues") == 2, "medium").otherwise("low")
    return s.select("v", "ord", "start", "cues", level.alias("confidence"))


def sample_windows(spans: DataFrame, interval: float = 30.0, frames: int = 3) -> DataFrame:
    """v, t, until, times: windows of ``interval`` over each [start, end) and their evenly spread sample times."""
    n = F.ceil((F.col("end") - F.col("start")) / interval).cast("int")
    each = spans.filter(F.col("end") > F.col("start")).select("v", "start", "end", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("t", F.col("start") + F.col("i") * F.lit(float(interval)))
    until = F.least(F.col("t") + interval, F.col("end"))
    return each.withColumn("until", until).select("v", "t", "until", F.array(*(F.col("t") + F.lit((k + 0.5) / frames) * (F.col("until") - F.col("t")) for k in range(frames))).alias("times"))


def shot_samples(shots: DataFrame, frames: int = 3) -> DataFrame:
    """v, ord, times: about a frame for every two seconds of a shot, one at least, ``frames`` at most."""
    dur = F.col("end") - F.col("start")
    n = F.greatest(F.lit(1), F.least(F.lit(frames), F.bround(dur / 2).cast("int")))
    s = shots.withColumn("n", n)
    return s.select("v", "ord", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.col("start") + (k + 0.5) / F.col("n") * dur).alias("times"))


def _cohesion(rows: pa.RecordBatch, block: int, width: int, stop: pa.Array) -> pa.RecordBatch:
    """v, gap, t, sim of whole timelines in order (v, start, dur, words): cosine of the word counts on either side of a gap.

    Counts meet as products of the blocks up to 2 * ``width`` apart that share a word, for all timelines at once; sums
    of whole numbers are exact in doubles.
    """
    v, start, dur = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    said = pc.split_pattern(rows.column(3), " ")
    coded = said.flatten().dictionary_encode()
    topic = pc.and_(pc.greater(pc.binary_length(coded.dictionary), 2), pc.invert(pc.is_in(coded.dictionary, stop))).to_numpy(zero_copy_only=False)
    word, row = coded.indices.to_numpy().astype(np.int64), pc.list_parent_indices(said).to_numpy().astype(np.int64)
    kept = topic[word]
    word, row = word[kept], row[kept]
    own = np.bincount(row, minlength=len(v))  # topic words of each row
    line = np.cumsum(np.concatenate([[0], v[1:] != v[:-1]]).astype(np.int64))
    size = np.bincount(line[row], minlength=line[-1] + 1)
    first, blocks = np.cumsum(size) - size, -(-size // block)
    blocks[blocks < 2 * width] = 0
    reach = 2 * width
    base = reach + np.cumsum(blocks + reach) - (blocks + reach)  # so many empty blocks between timelines that none meet
    many = int(base[-1] + blocks[-1] + reach)

    of = line[row]
    some = blocks[of] > 0
    at = base[of] + (np.arange(len(word)) - first[of]) // block
    key, n = np.unique((word * many + at)[some], return_counts=True)
    at, n = key % many, n.astype(np.float64)
    cells, products, k = [at * reach], [n * n], np.arange(len(key))
    for step in range(1, reach):
        k = k[k + step < len(key)]
        far = key[k + step] - key[k]
        k, far = k[far < reach], far[far < reach]
        cells.append(at[k] * reach + far)
        products.append(n[k] * n[k + step])
    shared = np.bincount(np.concatenate(cells), np.concatenate(products), many * reach).reshape(many, reach)

    inside = np.zeros(many + 1)  # by its end, the products within a window of ``width`` blocks
    total = np.concatenate([np.zeros((1, reach)), np.cumsum(shared, axis=0)])
    for far in range(width):
        inside[width:] += (1 if far == 0 else 2) * (total[width - far : many + 1 - far, far] - total[: many + 1 - width, far])
    gaps = np.maximum(blocks - 1, 0)
    of = np.repeat(np.arange(len(blocks)), gaps)
    gap = np.arange(len(of)) - (np.cumsum(gaps) - gaps)[of] + 1
    g = base[of] + gap
    ab = sum((shared[g - j, j : j + width].sum(axis=1) for j in range(1, width + 1)), np.zeros(len(g)))
    aa, bb = inside[g], inside[g + width]
    full = (aa > 0) & (bb > 0)
    sim = np.divide(ab, np.sqrt(aa) * np.sqrt(bb), out=np.zeros(len(g)), where=full)
    k = first[of] + gap * block
    r = row[k]
    t = start[r] + dur[r] * (k - (np.cumsum(own) - own)[r]) / own[r]
    return pa.RecordBatch.from_arrays([pa.array(v[r]), pa.array(gap.astype(np.int32)), pa.array(t), pa.array(sim)], ["v", "gap", "t", "sim"])


def lexical_similarity(turns: DataFrame, block: int = 20, width: int = 6) -> DataFrame:
    """v, gap, t, sim: cosine of the word counts of the ``width`` blocks on either side of each gap between blocks.

    A block is ``block`` topic words of a timeline in order; timelines of fewer than 2 * ``width`` blocks have none.  One
    exchange on the timeline; timelines are counted in whole arrays, some hundreds of turns at a time.
    """
    words = STOP_WORDS.split()

    def run(batches):
        stop, held = pa.array(words), []  # the turns of a timeline that may go on

        def result():
            all_ = pa.Table.from_batches(held)
            return _cohesion(all_.set_column(3, "w", all_.column(3).cast(pa.large_string())).combine_chunks().to_batches()[0], block, width, stop)

        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                v = b.column(0).to_numpy()
                last = int(np.searchsorted(v, v[-1]))
                if held and held[-1].column(0)[0].as_py() != v[0]:
                    yield result()
                    held = []
                if last == 0:
                    held.append(b)
                    continue
                held.append(b.slice(0, last))
                yield result()
                held = [b.slice(last)]
        if held:
            yield result()

    own = turns.filter("v is not null and text is not null").select("v", "ord", "start", F.greatest(F.col("end") - F.col("start"), F.lit(0.01)).alias("dur"), F.regexp_replace(F.lower("text"), "[^a-z']+", " ").alias("w"))
    return own.repartition("v").sortWithinPartitions("v", "ord").drop("ord").mapInArrow(run, "v long, gap int, t double, sim double")


def lexical_boundaries(turns: DataFrame, block: int = 20, width: int = 6, c: float = 0.3) -> DataFrame:
    """v, t: gaps whose valley is deeper than mean + c * deviation and the deepest among their neighbours.

    The climb on either side goes on while similarity does not fall, so its top is the value at the end of a
    monotone run; runs are islands of a window, not a loop.
    """
    w = Window.partitionBy("v").orderBy("gap")
    s = lexical_similarity(turns, block, width)
    down = F.coalesce((F.lag("sim").over(w) < F.col("sim")).cast("int"), F.lit(1))  # the walk to the left stops before a smaller value
    up = F.coalesce((F.lead("sim").over(w) < F.col("sim")).cast("int"), F.lit(1))
    s = s.withColumns({"_l": down, "_r": up})
    s = s.withColumns({"l": F.sum("_l").over(_running(w)), "r": F.sum("_r").over(w.rowsBetween(0, Window.unboundedFollowing))})
    top_l = F.first("sim").over(Window.partitionBy("v", "l").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0))
    top_r = F.last("sim").over(Window.partitionBy("v", "r").orderBy("gap").rowsBetween(0, Window.unboundedFollowing))
    d = s.withColumns({"lp": top_l, "rp": top_r}).withColumn("depth", (F.col("lp") - F.col("sim")) + (F.col("rp") - F.col("sim")))
    whole = Window.partitionBy("v")
    d = d.withColumns({"mean": F.avg("depth").over(whole), "dev": F.stddev_pop("depth").over(whole), "top": F.max("depth").over(w.rowsBetween(-1, 1))})
    return d.filter((F.col("depth") > F.col("mean") + c * F.col("dev")) & (F.col("depth") == F.col("top"))).select("v", F.round("t", 2).alias("t"))
