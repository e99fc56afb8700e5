"""Operators on hand-made rows, quirks and independent small models of the folds."""

import json
import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import kernels, scalars
from spanloom.operators import aggs, events, folds, intervals, joins, scoring, sequences
from spanloom.sources import documents, logs, views
from spanloom.streaming import adapters

R = "v long, ord long, start double, end double, kind string"


def spans(df):
    return sorted((r.v, r.start, r.end) for r in df.collect())


def made(spark, *rows):
    return spark.createDataFrame([(1, i, float(a), float(b), k) for i, (a, b, k) in enumerate(rows)], R)


def test_merge_is_inclusive_and_handles_containment(spark):
    df = made(spark, (0, 10, "black"), (2, 3, "black"), (12, 13, "white"), (15.01, 16, "snow"), (5, 5, "bars"))
    assert spans(intervals.merge_intervals(df, 2.0)) == [(1, 0, 13), (1, 15.01, 16)]
    assert spans(intervals.merge_intervals(df.limit(0), 2.0)) == []


def test_merge_laws(spark):
    rng = random.Random(2)
    data = [(rng.randrange(4), i, a := rng.uniform(0, 300), a + rng.uniform(0, 20), "black") for i in range(300)]
    df = spark.createDataFrame(data, R)
    once = intervals.merge_intervals(df, 1.0)
    again = intervals.merge_intervals(once.withColumn("ord", F.lit(0)), 1.0)
    shuffled = spark.createDataFrame(rng.sample(data, len(data)), R)
    assert spans(once) == spans(again) == spans(intervals.merge_intervals(shuffled, 1.0)) == spans(intervals.merge_salted(df, 1.0, 40.0))
    dur = df.groupBy("v").agg((F.max("end") + 5).alias("duration"))
    gaps = intervals.complement(intervals.merge_intervals(df, 0.0), dur, 0.0)
    both = sum(e - s for _, s, e in spans(gaps)) + sum(e - s for _, s, e in spans(intervals.merge_intervals(df, 0.0)))
    assert abs(both - sum(r.duration for r in dur.collect())) < 1e-6
    left = intervals.subtract(df.filter("ord % 2 = 0"), df.filter("ord % 2 = 1"), 0.0)
    holes = joins.right_side(df.filter("ord % 2 = 1"))
    assert joins.overlap_join(left, holes).filter("overlap > 1e-9").count() == 0


def test_bucketed_join_equals_plain(spark):
    rng = random.Random(3)
    a, b = (spark.createDataFrame([(rng.randrange(3), i, s := rng.uniform(0, 200), s + rng.choice([0, 5, 60]), "x") for i in range(150)], R) for _ in range(2))
    plain, bucketed = (joins.overlap_join(a, joins.right_side(b), bucket=w).select("v", "ord", "r_ord").collect() for w in (None, 17.0))
    assert sorted(plain) == sorted(bucketed) and plain


def test_dead_span_table(spark):
    dur = spark.createDataFrame([(1, 1000.0)], "v long, duration double")
    final = lambda *rows: [(r.start, r.end, r.kind) for r in intervals.dead_spans(made(spark, *rows), dur).orderBy("ord").collect()]
    assert final((100, 104, "black")) == [(100, 104, "black")] and final((100, 102, "black")) == []
    assert final((100, 102, "bars")) == [(98, 104, "bars")]
    assert final((100, 400, "silence")) == []
    assert final((100, 105, "black"), (105, 200, "silence")) == [(100, 105, "black")]
    assert final((100, 110, "snow"), (110, 120, "black")) == [(98, 122, "snow")]
    assert final((100, 104, "black"), (108, 130, "white")) == [(100, 130, "white")]
    speech = spark.createDataFrame([(1, 101.0, 110.0)], "v long, start double, end double")
    assert intervals.dead_spans(made(spark, (100, 112, "black")), dur, speech).count() == 0
    assert intervals.dead_spans(made(spark, (100, 112, "white")), dur, speech).count() == 1  # only black is vetoed as a run


def test_full_analysis_absorbs_short_content(spark):
    dur = spark.createDataFrame([(1, 100.0), (2, 50.0)], "v long, duration double")
    dead = spark.createDataFrame([(1, 0, 0.0, 10.0, "black"), (1, 1, 13.0, 20.0, "snow")], R)
    got = {r.v: r for r in intervals.full_analysis(dead, dur).collect()}
    assert [(d.start, d.end) for d in got[1].dead] == [(0, 13), (13, 20)] and [(c.start, c.end) for c in got[1].content] == [(20, 100)] and got[1].status == "OK"
    assert [(c.start, c.end) for c in got[2].content] == [(0, 50)]


def test_head_and_tail(spark):
    dur = spark.createDataFrame([(1, 100.0)], "v long, duration double")
    w = intervals.head_tail_window(made(spark, (0, 8, "freeze"), (3, 6, "bars"), (90, 100, "silence"), (92, 96, "black")), dur).first()
    assert (w.content_start, w.content_end, w.status) == (6, 92, "OK")
    whole = intervals.head_tail_window(made(spark, (0, 99, "freeze")), dur).first()
    assert (whole.content_start, whole.content_end, whole.status) == (0, 100, "NEEDS_REVIEW")
    assert intervals.head_leader_end(made(spark, (0, 5, "bars"), (8, 20, "black"), (40, 50, "snow"))).first().leader_end == 20
    assert intervals.head_leader_end(made(spark, (50, 60, "bars"))).first().leader_end == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert [one(scalars.category(lit(t))) for t in ("History lesson", "opening credits", "an ad ", "", "sports", "zzz")] == ["report", "credits", "other", "other", "sports", "other"]
    assert one(scalars.normalize_category(lit("concert"), lit(""), lit("a dance"))) == "performance"
    assert [one(scalars.title_card(lit(t))) for t in ("THE NEWS", "The News", "123", "", "ÉTÉ " * 20)] == [True, False, False, False, False]
    assert one(scalars.closed_label(lit(""))) == "dance performance" and one(scalars.taxonomy_label(lit(""), F.array(lit("a")))) == "other"
    assert one(scalars.taxonomy_label(lit("a commercial break"), F.array(lit("interview"), lit("announcement")))) == "announcement"
    assert one(scalars.output_name(lit("a/b/My*Clip.MP4"), lit("s"))) == "MyClip.mp4" and one(scalars.output_name(lit(None).cast("string"), lit("s"))) == "s_trimmed.mp4"
    assert one(scalars.media_format(lit("x.MOV"))) == "mp4" and one(scalars.media_format(lit("x.avi"))) is None
    assert one(scalars.original_name(lit(None).cast("string"), F.create_map(lit("filename"), lit("u.mp4")), lit("a/k.mp4"))) == "u.mp4"
    assert [(r.idx, r.category) for r in one(scalars.reply_lines(lit("1 / interview / X\n2 / zzz / y\n1 / tv show / z")))] == [(2, "other"), (1, "tv show")]
    assert [r.a for r in one(scalars.salvaged_objects(lit('[{"a": 1}, {"a": 2}, {"a": '), "a int"))] == [1, 2]


def test_logs(spark):
    log = "black_start:0 black_end:12.5 black_duration:12.5\nfreeze_start: 30.0\nfreeze_end: 41.0\nfreeze_start: 90\nsilence_start: -0.01\nsilence_end: 15.2"
    df = spark.createDataFrame([(1, log, 100.0)], "v long, log string, duration double")
    assert spans(logs.paired(df, "black")) == [(1, 0, 12.5)]
    assert spans(logs.alternating(df, "freeze")) == [(1, 30, 41), (1, 90, 100)] and spans(logs.alternating(df, "silence")) == [(1, 0, 15.2)]
    probe = spark.createDataFrame([(1, "Input: x.mp4  (duration 1969.43s)\n  [    0.00 ->    12.50]  black\n [1.0 -> 2.0] bars")], "v long, log string")
    assert [(r.duration, r.start, r.end, r.kind) for r in logs.probe_log(probe).orderBy("ord").collect()] == [(1969.43, 0, 12.5, "black"), (1969.43, 1, 2, "bars")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video": "a", "segments": [{"segment_start": 0, "segment_end": 7.5, "segment_type": "D"}, {"start": 7.5, "end": 9}, {"end": 3}]}, indent=1))
    docs = documents.read_timelines(spark, str(tmp_path))
    assert [(r.stem, r.start, r.end) for r in documents.segments_of(docs).orderBy("ord").collect()] == [("a", 0, 7.5), ("a", 7.5, 9)]
    shapes = spark.createDataFrame([(1, '{"segments": [{"start": 4, "end": 9}, {"start": 2}]}'), (2, '{"boundaries": [3, 1], "duration": 8}'), (3, "[5, 4]")], "v long, value string")
    assert [(r.v, r.bounds, r.duration) for r in documents.read_boundaries(shapes).orderBy("v").collect()] == [(1, [2, 4], 9), (2, [1, 3], 8), (3, [4, 5], 5)]
    raw = {"results": {"items": [{"type": "x", "start_time": "0.0", "end_time": "0.5", "alternatives": [{"content": "hi"}]}, {"type": "x", "start_time": "0.6", "end_time": "1", "alternatives": [{"content": "you"}]}], "speaker_labels": {"segments": [{"start_time": "0.0", "end_time": "1.0", "speaker_label": "spk_1", "items": [{"start_time": "0.0"}, {"start_time": "0.6"}]}]}, "transcripts": [{"transcript": "hi you"}]}}
    plain = {"results": {"items": raw["results"]["items"], "transcripts": [{"transcript": "hi you"}]}}
    df = spark.createDataFrame([("d", json.dumps(raw)), ("p", json.dumps(plain))], "v string, value string")
    assert sorted((r.v, r.speaker, r.start, r.end, r.text) for r in documents.asr_turns(df).collect()) == [("d", "spk_1", 0, 1, "hi you"), ("p", "spk_0", 0, 1, "hi you")]


T = "v long, ord long, speaker string, start double, end double, text string"


def test_speakers(spark):
    t = spark.createDataFrame([(1, 0, "a", 0.0, 4.0, "x"), (1, 1, "a", 6.9, 7.0, "y"), (1, 2, "a", 10.0, 11.0, "z"), (1, 3, None, 11.0, 20.0, "w")], T)
    assert [(r.start, r.end, r.text) for r in sequences.merge_same_speaker(t).orderBy("ord").collect()] == [(0, 7, "x y"), (10, 11, "z"), (11, 20, "w")]
    assert aggs.detect_host(t).first().host == "a"
    shots = spark.createDataFrame([(1, 0, 0.0, 5.0, [], 0.0), (1, 1, 5.0, 9.0, ["a"], 1.0), (1, 2, 9.0, 12.0, ["a", "b"], 1.0), (1, 3, 12.0, 13.0, ["a"], 0.1), (1, 4, 13.0, 15.0, ["b"], 0.9)], "v long, ord long, start double, end double, speakers array<string>, speech_frac double")
    hosts = spark.createDataFrame([(1, "a")], "v long, host string")
    assert [(r.start, r.end, r.role) for r in sequences.merge_by_speaker(shots, hosts).orderBy("ord").collect()] == [(0, 9, "host"), (9, 15, "guest")]


def test_lexical_boundaries_against_a_plain_walk(spark):
    rng = random.Random(8)
    words = lambda k: " ".join(rng.choice([f"w{c}{d}x" for c in "abcdef" for d in f"{'klm' if k else 'pqr'}"]) for _ in range(200))
    text = " ".join(words(k % 2) for k in range(4))
    t = spark.createDataFrame([(1, 0, "a", 0.0, 800.0, text)], T)
    sims = [(r.t, r.sim) for r in sequences.lexical_similarity(t).orderBy("gap").collect()]
    depth = []
    for i, (_, s) in enumerate(sims):
        top = []
        for step in (-1, 1):
            j = i
            while 0 <= j + step < len(sims) and sims[j + step][1] >= sims[j][1]:
                j += step
            top.append(sims[j][1])
        depth.append(sum(top) - 2 * s)
    bar = np.mean(depth) + 0.3 * np.std(depth)
    want = [round(sims[i][0], 2) for i, d in enumerate(depth) if d > bar and d == max(depth[max(0, i - 1) : i + 2])]
    got = sorted(r.t for r in sequences.lexical_boundaries(t).collect())
    assert got == pytest.approx(want) and got


def test_folds(spark):
    S = "v long, ord long, start double, end double, role string, guests array<string>, label string, name string, speakers array<string>"
    row = lambda i, a, b, g, l="x": (1, i, float(a), float(b), "guest" if g else "host", [g] if g else [], l, f"n{i}", [g or "h"])  # noqa: E731, E741
    story = lambda *rows, cut=None: [(r.start, r.end) for r in folds.coalesce_conversation(spark.createDataFrame(list(rows), S), cut).orderBy("ord").collect()]
    assert story(row(0, 0, 10, "g"), row(1, 10, 90, ""), row(2, 90, 95, "g")) == [(0, 95)]
    assert story(row(0, 0, 10, "g"), row(1, 10, 25, ""), row(2, 25, 40, "k")) == [(0, 10), (10, 40)]
    assert story(row(0, 0, 10, "g"), row(1, 10, 50, ""), row(2, 50, 60, "k")) == [(0, 10), (10, 50), (50, 60)]
    assert story(row(0, 0, 10, ""), row(1, 10, 20, ""), row(2, 20, 30, "", "y")) == [(0, 20), (20, 30)]
    cut = spark.createDataFrame([(1, 10.2, 10.8)], "v long, start double, end double")
    assert story(row(0, 0, 10, "g"), row(1, 11, 20, "g"), cut=cut) == [(0, 10), (11, 20)]
    L = "v long, ord long, start double, end double, label string"
    lab = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (1, 1, 10.0, 12.0, "b"), (1, 2, 12.0, 30.0, "a"), (1, 3, 30.0, 33.0, "c")], L)
    assert [(r.start, r.end, r.label) for r in folds.consolidate_segments(lab, 0, 5.0).collect()] == [(0, 33, "a")]
    assert [(r.start, r.end) for r in folds.consolidate_segments(lab, 2, 0.0).orderBy("ord").collect()] == [(0, 30), (30, 33)]
    pts = lambda *ts: spark.createDataFrame([(1, float(t)) for t in ts], "v long, t double")
    assert [(r.tp, r.fp, r.fn) for r in folds.match_greedy(pts(2, 5), pts(4, 7), (2.0,)).collect()] == [(1, 1, 1)]
    shots = spark.createDataFrame([(1, i, f) for i, f in enumerate([3] * 7 + [18, 1])], "v long, ord long, frames long")
    assert [r.batch for r in folds.batch_shots(shots).orderBy("ord").collect()] == [0, 0, 0, 0, 0, 1, 1, 2, 3]
    tax = spark.createDataFrame([(1, 0, "Guest interview", "d"), (1, 1, "interview", "e"), (1, 2, "News", "f")], "v long, ord long, type string, definition string")
    assert [(r.type, r.definition) for r in folds.merge_taxonomies(tax).orderBy("ord").collect()] == [("Guest interview", "d"), ("News", "f")]


def test_split_on_topics_absorbs_short_pieces(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 60.0, 65.0)], "v long, ord long, start double, end double")
    cuts = spark.createDataFrame([(1, 20.0), (1, 24.0), (1, 57.0)], "v long, t double")
    shots = spark.createDataFrame([(1, 0, 22.0, 23.0)], "v long, ord long, start double, end double")
    assert spans(joins.split_on_topics(seg, cuts, shots)) == [(1, 0, 22), (1, 22, 65)]


def test_scores(spark):
    t = spark.createDataFrame([(1,), (2,)], "v long")
    a = made(spark, (0, 10, "D"), (5, 12, "D"), (20, 30, "D"))
    d = {r.v: r for r in scoring.dead_metrics(a, a, t).collect()}
    assert (d[1].f1, d[1].iou, d[2].f1, d[2].iou) == (1, 1, 1, 1)
    b = {r.v: r for r in scoring.boundary_metrics(scoring.span_points(a), scoring.span_points(a.limit(0)), t).collect()}
    assert (b[1].precision, b[1].recall, b[1].f1, b[2].f1) == (0, 0, 0, 1)
    dur = spark.createDataFrame([(1, 100.0)], "v long, duration double")
    p = spark.createDataFrame([(1, 30.0), (1, 60.0)], "v long, t double")
    e = scoring.segmentation_errors(p, p, dur).first()
    assert (e.n, e.k, e.pk, e.windowdiff) == (100, 17, 0, 0) or (e.n, e.k) == (100, 16)


def test_boundaries_round_as_in_sql(spark):
    """1.005 * 100 is a double less than 100.5, so 1.005 and 1.0 are one boundary."""
    values = [1.005, 2.675, 584.105, 17.525, 0.285, 40.0, -1.005]
    sql = [duckdb.execute(f"select round({x!r}::double, 2)").fetchall()[0][0] for x in values]
    df = spark.createDataFrame([(1, x) for x in values], "v long, t double")
    assert [r.t for r in df.select(scalars.rounded("t", 2).alias("t")).collect()] == sql
    pred = spark.createDataFrame([(1, 1.0), (1, 1.005), (1, 10.0)], "v long, t double")
    got = scoring.boundary_metrics(pred, pred.filter("t = 10"), pred.select("v").distinct()).collect()[0]
    assert (got.precision, got.recall) == (0.5, 1.0)


def plain_cohesion(words, block, width):
    """The counts of both windows, made anew for each gap."""
    n = -(-len(words) // block)
    for gap in range(1, n if n >= 2 * width else 1):
        a, b = Counter(words[max(0, gap - width) * block : gap * block]), Counter(words[gap * block : (gap + width) * block])
        ab, aa, bb = (float(sum(x[w] * y[w] for w in x)) for x, y in ((a, b), (a, a), (b, b)))
        yield gap, ab / (math.sqrt(aa) * math.sqrt(bb))


def test_lexical_similarity_of_long_and_short_timelines(spark):
    """Timelines of one and of many turns, beyond a batch, too short ones and turns without topic words, to the bit."""
    rng = random.Random(5)
    said = [(v, i, float(i), i + 0.5 + v, " ".join(rng.choice(("the", "of", "", "x")) if v % 5 == 1 and i % 3 == 0 else f"w{chr(97 + rng.randrange(9))}{'abc'[v % 3]}" for _ in range(rng.randrange(1, 9)))) for v, k in enumerate([3, 1200, 40, 1, 9, 640, 500, 12, 2000]) for i in range(k)]
    turns = spark.createDataFrame(said, "v long, ord long, start double, end double, text string")
    got = {(r.v, r.gap): (r.t, r.sim) for r in sequences.lexical_similarity(turns.repartition(3), 4, 3).collect()}
    want = {}
    for v in range(9):
        own = [(x, s, max(e - s, 0.01)) for u, _, s, e, text in said if u == v for x in [[w for w in text.split(" ") if len(w) > 2 and w not in sequences.STOP_WORDS.split()]]]
        words, times = [w for x, _, _ in own for w in x], [s + d * i / len(x) for x, s, d in own for i in range(len(x))]
        want |= {(v, gap): (times[4 * gap], sim) for gap, sim in plain_cohesion(words, 4, 3)}
    assert got == want and len(want) > 3000


def test_lexical_similarity_is_quicker_than_a_walk():
    rng = random.Random(6)
    words = [[f"word{int(rng.paretovariate(0.7)) % 5000}" for _ in range(2000)] for _ in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([0.0] * 100), pa.array([9.0] * 100), pa.array([" ".join(x) for x in words], pa.large_string())], ["v", "start", "dur", "w"])
    began = time.process_time()
    out = sequences._cohesion(rows, 20, 6, pa.array(["the"]))
    ours, began = time.process_time() - began, time.process_time()
    assert out.column(3).to_pylist() == [sim for x in words for _, sim in plain_cohesion(x, 20, 6)]
    assert ours < (time.process_time() - began) / 3


def test_scores_make_no_pairs_and_agree_with_pairs(spark):
    rng = random.Random(7)
    a, b = ([(v, i, float(s), float(s + rng.randrange(0, 9)), "D") for v in range(6) for i, s in enumerate(rng.sample(range(120), 14 if v else 0))] for _ in "pg")
    pred, gold = (spark.createDataFrame(x, R) for x in (a, b))
    t = spark.createDataFrame([(v,) for v in range(6)], "v long")
    dead, bounds = scoring.dead_metrics(pred, gold, t), scoring.boundary_metrics(scoring.span_points(pred), scoring.span_points(gold), t)
    for df in (dead, bounds):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    d, m = ({r.v: r for r in x.collect()} for x in (dead, bounds))
    assert sorted(d) == sorted(m) == list(range(6))
    for v in range(6):
        p, g = ({s for r in x if r[0] == v for s in range(int(r[2]), int(r[3]))} for x in (a, b))
        assert d[v].precision == pytest.approx(len(p & g) / len(p) if p else float(not g)) and d[v].recall == pytest.approx(len(p & g) / len(g) if g else float(not p))
        p, g = ({x for r in y if r[0] == v and r[3] > r[2] for x in r[2:4]} for y in (a, b))
        hit = lambda x, y: sum(any(abs(i - j) <= 2 for j in y) for i in x)
        assert m[v].precision == pytest.approx(hit(p, g) / len(p) if p else float(not g)) and m[v].recall == pytest.approx(hit(g, p) / len(g) if g else float(not p))


def test_subtraction_joins_once_and_agrees_with_cells(spark):
    rng = random.Random(3)
    own, holes = ([(v, i, float(s), float(s + rng.randrange(0, 12)), "D") for v in range(4) for i, s in enumerate(rng.sample(range(150), 15 if v or side else 4))] for side in (0, 1))
    out = intervals.subtract(spark.createDataFrame(own, R).drop("kind"), spark.createDataFrame([x for x in holes if x[0] < 3], R).select("v", "start", "end"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = set()
    for v, i, s, e, _ in own:
        cells = [c for c in range(int(s), int(e)) if not any(h[0] == v < 3 and h[2] <= c < h[3] for h in holes)]
        want |= {(v, i, float(c), float(next(x for x in range(c + 1, 999) if x not in cells))) for c in cells if c - 1 not in cells}
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_tasks_have_a_fixed_number_of_rows(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("v"))
    assert [views.by_timeline(df.limit(n), n, 100).rdd.getNumPartitions() for n in (1000, 5000)] == [10, 50]


def test_events(spark):
    data = [("ObjectCreated:Put", "video/a.mp4", 1 << 21), ("ObjectCreated:CompleteMultipartUpload", "video/b.MOV", 1 << 21), ("ObjectCreated:Copy", "video/a.mp4", 1), ("ObjectCreated:Put", "edit/x_trim_request.json", 9), ("ObjectCreated:Put", "edit/x_segment_request.json", 9), ("ObjectCreated:Put", "other/a.mp4", 9), ("ObjectCreated:Put", "video/a.mp4", 9), ("ObjectCreated:Put", "video/a.txt", 1 << 21)]
    raw = json.dumps({"Records": [{"eventName": e, "s3": {"bucket": {"name": "b"}, "object": {"key": k, "size": n}}} for e, k, n in data]})
    routed = events.route_events(events.parse_events(spark.createDataFrame([(raw,)], "value string")))
    assert [r.route for r in routed.orderBy("id").collect()] == ["process", "process", "skip_copy", "trim", "segment", "skip", "reject_size", "reject_type"]
    assert events.event_status(routed).first().status == 200 and events.event_status(routed.filter("route like 'reject%'")).first().status == 400
    rows = events.catalogue_rows(routed)
    assert [r.id for r in events.insert_if_absent(rows.union(rows), rows.filter("id = 'a'")).collect()] == ["b"]
    trim = spark.createDataFrame([('{"video_key": "k", "keep_segments": [{"start": 5, "end": 8}, {"start": 10, "end": 14}]}',), ("{}",)], "value string")
    assert [(r.start, r.out_start) for r in events.edit_list(events.requests(trim)).orderBy("ord").collect()] == [(5, 0), (10, 3)]


def test_stream_routing_and_sessions(spark, tmp_path):
    e = spark.createDataFrame([("Put", "video/a.mp4", 1 << 21), ("Put", "video/a.mp4", 1 << 21), ("Put", "video/c.mp4", 1 << 21)], "event string, key string, size long")
    for k in range(2):
        e.write.mode("append").parquet(str(tmp_path / "in"))
        adapters.route_stream(adapters.stream_table(spark, str(tmp_path / "in"), e.schema), str(tmp_path / "cat"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "cat")).collect()) == ["a", "c"]
    s = spark.createDataFrame([(1, f"2024-01-01 00:00:{x:02d}") for x in (0, 5, 10, 30)], "v long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in adapters.sessions(s, "ts", "5 seconds").collect()) == [1, 3]


def test_kernels(spark):
    rng = np.random.default_rng(0)
    bars = np.zeros((90, 160, 3), np.uint8)
    for k, c in enumerate([(0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 255, 255), (255, 0, 255), (255, 255, 0), (20, 20, 200)]):
        bars[:, k * 23 : (k + 1) * 23] = c
    flat = np.full((90, 160, 3), 120, np.uint8)
    noise = rng.integers(0, 256, (90, 160, 3), dtype=np.uint8)
    assert [kernels.bars_kernel(x)[3] for x in (bars, flat, noise)] == [True, False, False]
    a, b = (rng.integers(0, 256, (256, 256), dtype=np.uint8) for _ in range(2))
    assert [kernels.snow_kernel(*x)[4] for x in ((a, b), (a, a), (None, a))] == [True, False, False]
    df = spark.createDataFrame([(bytearray(bars.tobytes()), 90, 160)], "frame binary, h int, w int")
    assert df.select(kernels.bars_score("frame", "h", "w").alias("s")).first().s.is_bars

    def fails(pdf):
        raise ValueError

    assert kernels.classify(spark.range(3), fails).select("label").distinct().first().label == "other"
