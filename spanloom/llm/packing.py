"""Best-fit packing planned on a histogram of lengths.

Texts become pieces of at most ``capacity`` tokens.  The plan is best-fit decreasing over *counts*: all
bins of equal room are one group, so planning takes time and memory by distinct lengths (at most
``capacity``), not by documents.  Pieces then take the planned slots by their rank within their length;
ranks come from counts by (length, bucket), so that no length, however frequent, is sorted in one task: n pieces of a
length have the square root of n buckets at most.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WORDS, byte_symbols
from .common import lean, materialize

#: Texts beyond this many characters go to the tokenizers library, whose pre-tokenizer has no stack limit.
LONG = 400_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to the uint32 ids that the vocabulary file of the tokenizers library gives.

    The ids come from tiktoken, with the ranks taken from that file (the same ids, tested over all code
    points, in a fifth of the CPU time); very long texts go to the tokenizers library itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {t: i for t, i in ranks.items() if i not in added.values()}
    fast = tiktoken.Encoding("spanloom", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=added)
    slow = []

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(path))
            ids = slow[0].encode(text, add_special_tokens=False).ids
        elif any(t in text for t in added):
            ids = fast.encode(text, allowed_special="all")
        else:
            ids = fast.encode_ordinary(text)
        return np.array(ids, dtype="<u4")

    return encode


def pieces(df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 (and ids) of every text's pieces.

    A document is its ids and ``end_id``; null counts as empty, so every document has a piece.  Longer ones
    are cut into pieces of ``capacity``; the first takes what is over.
    """

    def run(batches):
        encode = encoder(vocab_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                doc, number, start, length, crc, kept = [], [], [], [], [], []
                for d, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.array([end_id], "<u4"))
                    n = len(ids)
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        doc.append(d)
                        number.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(ids[x:y].tobytes()))
                        if with_ids:
                            kept.append(ids[x:y])
                cols = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return df.select(id_col, text_col).mapInArrow(lean(run), schema)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slots and the number of sequences.

    A slot (length, first rank, count, first sequence, offset) holds the pieces of this length from that
    rank on, one in each of ``count`` consecutive sequences, at ``offset``.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, count) of bins
    sequences = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, count: int, free: int) -> None:
            """Stack as many as fit into ``count`` like bins, bin after bin, as best fit would."""
            nonlocal left, rank
            each = free // length
            whole = min(count, left // each)
            parts = [(first, whole, each)] if whole else []
            if whole < count and left - whole * each:
                parts.append((first + whole, 1, left - whole * each))
            used = 0
            for begin, bins, deep in parts:
                for level in range(deep):
                    slots.append((length, rank, bins, begin, capacity - free + level * length))
                    rank += bins
                left -= bins * deep
                used += bins
                room.setdefault(free - deep * length, []).append((begin, bins))
            if used < count:
                room.setdefault(free, []).append((first + used, count - used))

        for free in sorted(f for f in room if f >= length):
            if not left:
                break
            for first, count in room.pop(free):
                if left:
                    fill(first, count, free)
                else:
                    room.setdefault(free, []).append((first, count))
        if left:
            bins = -(-left // (capacity // length))
            first, sequences = sequences, sequences + bins
            fill(first, bins, capacity)
    return slots, sequences


def pack(cut: DataFrame, capacity: int = 2048, id_col: str = "doc_id", bucket_rows: int = 1 << 9) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``cut`` has id_col, piece and length (1 to ``capacity``).

    Offsets are gapless from 0 in every sequence.  Ties (equal lengths) rank by bucket, id and piece; an
    empty table gives an empty result.  The histogram and the plan, all that reaches the driver, are
    bounded by ``capacity``.
    """
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slots, _ = plan(histogram, capacity)
    slots.sort()
    many = cut.sparkSession.createDataFrame([(k, -(-n // max(bucket_rows, math.isqrt(n)))) for k, n in histogram.items()], "length long, buckets int")
    keyed = cut.join(F.broadcast(many), "length").withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece"), "buckets").cast("int")).drop("buckets")
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    own = Window.partitionBy("length", "bucket").orderBy(F.col(id_col), "piece", "start")
    ranked = keyed.withColumn("rank", F.row_number().over(own) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("rank_before")).drop("rank_before", "bucket")
    table = np.array(slots or [(0, 0, 0, 0, 0)], dtype=np.int64)
    lengths, at = np.unique(table[:, 0], return_index=True)
    ends = np.append(at[1:], len(table))

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            slot = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(lengths, x)
                slot[rows] = at[k] + np.searchsorted(table[at[k] : ends[k], 1], rank[rows], "right") - 1
            keep = [c for c in b.schema.names if c != "rank"]
            sequence = table[slot, 3] + rank - table[slot, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(table[slot, 4])], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset: every text, encoded, cut and packed."""
    cut = materialize(pieces(df, vocab_path, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity, id_col).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
