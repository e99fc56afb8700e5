"""Sharding by sampled splitters.

Records are ordered by (64-bit hash of the text, id), so copies lie side by side yet a large group can
be cut anywhere.  A size-weighted sample of bounded size gives quantile boundaries; ranges that turn out
overfull by exact count are subdivided from a sample of their own, until none is.  Within a range one sort gives each
record its exact byte position, hence its shard and its slot.  Records larger than a ``LARGE``-th of a shard, of which there
are at most ``LARGE`` a shard, are dealt first, the largest to the least full shard; the others fill up what these leave.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIX = 0x5EED
LARGE = 128


def _sample(rows: DataFrame, total: int, want: int, seed: int) -> list[tuple[int, int, float]]:
    """About ``want`` (key, id, weight), each drawn in proportion to its size; larger records weigh more."""
    share = F.col("size") * F.lit(want / max(total, 1))
    u = F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.filter(u < share).select("key", "id", F.greatest(share, F.lit(1.0)).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """parts - 1 boundaries, at most, that cut the sample's weight evenly."""
    whole, run, out = sum(w for *_, w in sample), 0.0, []
    for key, id_, w in sample:
        run += w
        if run * parts >= whole * (len(out) + 1) and len(out) < parts - 1:
            out.append((key, id_))
    return sorted(set(out))


def _assign(rows: DataFrame, boundaries: list[tuple[int, int]]) -> DataFrame:
    """Adds ``part``: the number of boundaries that are not above (key, id)."""
    keys = np.array([k for k, _ in boundaries], dtype=np.int64)
    ids = np.array([i for _, i in boundaries], dtype=np.int64)

    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            id_ = b.column("id").to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            part = lo.copy()
            for at in np.unique(lo[lo < hi]):  # on boundaries' own keys the id decides
                own = np.flatnonzero((lo == at) & (lo < hi))
                part[own] = at + np.searchsorted(ids[at : hi[own[0]]], id_[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    return rows.mapInArrow(run, "id long, size long, text_crc32 long, key long, part int")


def _dealt(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each of the sizes, largest first to the least full, and the shards' loads."""
    heap, load, out = [(0, s) for s in range(shards)], [0] * shards, []
    for size in sizes:
        _, s = heapq.heappop(heap)
        load[s] += size
        out.append(s)
        heapq.heappush(heap, (load[s], s))
    return out, load


def _room(load: list[int], small: int) -> list[int]:
    """Where each shard ends in the run of ``small`` bytes, so that all fill up to one level."""
    shards, level = len(load), 0.0
    for k, x in enumerate(sorted(load), 1):
        if k == shards or (small + sum(sorted(load)[:k])) / k <= sorted(load)[k]:
            level = (small + sum(sorted(load)[:k])) / k
            break
    ends, run = [], 0.0
    for x in load:
        run += max(level - x, 0)
        ends.append(round(run))
    return ends


def shard_by_bytes(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", ranges: int = 0, oversample: int = 16, overfull: float = 2.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record, by the law ``bytes``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16.  Shards hold consecutive records of the order
    (text hash, id), besides large ones, and differ in bytes by less than a hundredth of their mean, unless a single record exceeds it.
    Slots are gapless from 0.  Sample and boundaries are bounded by ``ranges`` * ``oversample``, the large records by ``LARGE`` *
    ``shards``, whatever the input.  Repeated rows are separate records; null ids count as the least; extra columns aren't read; an
    empty table gives an empty result.
    """
    ranges = ranges or 8 * shards
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(MIX)).alias("key")),
        "sizes",
    )
    cut = (rows.agg(F.sum("size")).first()[0] or 0) // (shards * LARGE)
    large = sorted(((r[1], r[0], r[2]) for r in rows.filter(F.col("size") > cut).select("id", "size", "text_crc32").collect()), reverse=True)
    where, load = _dealt([size for size, *_ in large], shards)
    rows = rows.filter(F.col("size") <= cut)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    ends = _room(load, total)
    boundaries = _quantiles(_sample(rows, total, ranges * oversample, 1), ranges) if count else []
    attempt = 0
    while True:
        parts = _assign(rows, boundaries)
        sums = {r[0]: (r[1], r[2], r[3]) for r in parts.groupBy("part").agg(F.sum("size"), F.count("*"), F.max("size")).collect()}
        full = [p for p, (b, n, most) in sums.items() if n > 1 and b - most > overfull * total / ranges]
        within = parts.filter(F.col("part").isin(full))
        heavy = sum(sums[p][0] for p in full)
        drawn = _sample(within.select("id", "size", "key"), heavy, len(full) * 8 * oversample, 2 + attempt) if full else []
        cuts: set[tuple[int, int]] = set()
        for p in full:
            own = [s for s in drawn if bisect_right(boundaries, (s[0], s[1])) == p]
            cuts.update(_quantiles(own, max(2, round(2 * sums[p][0] * ranges / max(total, 1)))))
        if cuts <= set(boundaries):  # nothing overfull, but for rows that repeat
            break
        boundaries, attempt = sorted({*boundaries, *cuts}), attempt + 1
    spark, at_bytes, at_rows, offsets = df.sparkSession, 0, 0, []
    for p in sorted(sums):
        offsets.append((p, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[p][0], at_rows + sums[p][1]
    before = spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    order = Window.partitionBy("part").orderBy("key", "id", "size", "text_crc32")
    placed = (
        parts.withColumns({"run": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "row": F.row_number().over(order) - 1})
        .join(F.broadcast(before), "part")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("run")) - F.col("size"))
        .select(
            "id", "size", "text_crc32",
            F.least(F.lit(shards - 1), F.size(F.filter(F.array(*(F.lit(2 * e).cast("long") for e in ends)), lambda e: e <= F.col("twice_middle")))).alias("shard"),
            (F.col("rows_before") + F.col("row")).cast("long").alias("at"),
        )
    )
    placed = materialize(placed, "placed")
    first = {r[0]: (r[1], r[2]) for r in placed.groupBy("shard").agg(F.min("at"), F.count("*")).collect()}
    begins = F.array(*(F.lit(first.get(k, (0, 0))[0]).cast("long") for k in range(shards)))
    small = placed.select("id", "size", "text_crc32", "shard", (F.col("at") - F.get(begins, F.col("shard"))).alias("slot"))
    used, more = [first.get(k, (0, 0))[1] for k in range(shards)], []
    for (size, id_, crc), k in zip(large, where):
        more.append((id_, size, crc, k, used[k]))
        used[k] += 1
    both = small.unionByName(spark.createDataFrame(more, "id long, size long, text_crc32 long, shard int, slot long")) if more else small
    return both.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
