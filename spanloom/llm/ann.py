"""Approximate nearest neighbours by an inverted multi-index (largest inner product).

Vectors are cut in halves, each quantised by its own codebook (k-means on a bounded sample); a pair of
centroids is a cell.  A query walks the cells by summed centroid score with a heap until it has gathered its
share of the rows.  That share is calibrated on the sample: it is what ``target`` of the sample's true neighbours
need, which is safe, since in the full set neighbours are nearer.  Entries of the walked cells are reranked by
the exact product.

Equal vectors are one entry with its least ids: no query can return more than k + 1 of them, since ties go to
smaller ids.  Entries of one first centroid are dealt into blocks of bounded size, queries into slices of bounded
size; each slice reaches all the blocks, and a task multiplies few queries at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE, CALIBRATE, BLOCK, ASKING, AT_ONCE = 16_384, 256, 4096, 1 << 15, 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids of the rows of ``x``."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return (2 * (x @ c.T) - (c * c).sum(axis=1)).argmax(axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: float):
    """Cells (i, j) by descending first[i] + second[j], from a heap, until their sizes sum to ``enough``."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    fa, fb = first[a].tolist(), second[b].tolist()
    na, nb = len(a), len(b)
    heap = [(-(fa[0] + fb[0]), 0, 0)]
    got = 0
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        n = sizes[a[i]][b[j]]
        if n:
            got += n
            yield a[i], b[j]
        if j + 1 < nb:
            heapq.heappush(heap, (-(fa[i] + fb[j + 1]), i, j + 1))
        if j == 0 and i + 1 < na:  # each cell is pushed once: along its row, rows by their first cell
            heapq.heappush(heap, (-(fa[i + 1] + fb[0]), i + 1, 0))


class Index:
    """Two codebooks, and the share of rows to gather."""

    def __init__(self, sample: np.ndarray, k: int, neighbours: int, target: float):
        self.half = max(1, sample.shape[1] // 2)
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.share = self._calibrated(sample, neighbours, target)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, : self.half], self.first), nearest(x[:, self.half :], self.second)

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[: self.half] @ self.first.T, q[self.half :] @ self.second.T

    def _calibrated(self, sample: np.ndarray, neighbours: int, target: float) -> float:
        n = len(sample)
        if n <= neighbours + 1:
            return 1.0
        c1, c2 = self.cells(sample)
        k2 = len(self.second)
        cell = c1 * k2 + c2
        sizes = np.bincount(cell, minlength=len(self.first) * k2)
        need = []
        for q in np.linspace(0, n - 1, min(n, CALIBRATE)).astype(int):
            s = sample @ sample[q]
            s[q] = -np.inf
            top = np.argpartition(-s, neighbours)[:neighbours]
            a, b = self.scores(sample[q])
            order = np.argsort(-(a[:, None] + b[None]).ravel(), kind="stable")
            reach = np.empty(len(order))
            reach[order] = np.cumsum(sizes[order])
            need += (reach[cell[top]] / n).tolist()
        return float(min(1.0, np.quantile(need, target)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def nearest_neighbours(df: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = 0, target: float = 0.96) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest other rows, nearest first, ties to smaller ids.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do null ids.  Where
    lengths differ, shorter vectors count as continued by zeros.  Rows of one id count once, with the least of their vectors.
    Extra columns aren't read.  An empty table, or one vector, gives an empty result.  ``centroids`` per half: by default
    sqrt(rows) / 3, 8 to 256.
    """
    spark = df.sparkSession
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    dim, short = rows.agg(F.max(F.size(v)), F.min(F.size(v))).first()
    dim = dim or 2
    if short != dim:
        rows = rows.withColumn("vec", F.concat(v, F.array_repeat(F.lit(0).cast(rows.schema["vec"].dataType.elementType), dim - F.size(v))))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    order = Window.partitionBy("vec").orderBy("id")
    least = rows.select("vec", "id").withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k + 1)
    entries = materialize(least.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("node", F.col("ids")[0]), "entries", tidy=True)
    asked = rows.filter("asks").select("vec", F.col("id").alias("query_id")).distinct().join(entries.select("vec", "node"), "vec").select("query_id", "node")
    asked = materialize(asked, "asked")
    n = entries.count()
    u = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = entries.filter(u < SAMPLE / max(n, 1)).select("node", "vec").toArrow() if n else None
    sample = _matrix(drawn.column("vec").combine_chunks(), dim)[np.argsort(drawn.column("node").to_numpy())] if drawn is not None and drawn.num_rows else np.ones((1, dim))
    index = Index(sample, centroids or min(256, max(8, int(n**0.5 / 3))), k, target)
    shared = spark.sparkContext.broadcast(index)

    def placed(batches):
        for b in batches:
            c1, c2 = shared.value.cells(_matrix(b.column(1), dim)) if b.num_rows else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], [*b.schema.names, "c1", "c2"])

    element = rows.schema["vec"].dataType.simpleString()
    cells = materialize(entries.select("node", "vec", "ids").mapInArrow(placed, f"node long, vec {element}, ids array<long>, c1 int, c2 int"), "cells")
    sizes = np.zeros((len(index.first), len(index.second)), dtype=np.int64)
    for a, b, m in cells.groupBy("c1", "c2").count().collect():  # at most 256 x 256
        sizes[a, b] = m
    blocks = np.maximum(1, -(-sizes.sum(axis=1) // BLOCK))
    plan = spark.sparkContext.broadcast((sizes.tolist(), blocks.tolist(), index.share * n))

    def walked(batches):
        sizes, blocks, enough = plan.value
        for b in batches:
            x = _matrix(b.column(1), dim) if b.num_rows else np.zeros((0, dim))
            at, first, block, second = [], [], [], []
            for r in range(len(x)):
                by: dict[int, list[int]] = {}
                for i, j in walk(*shared.value.scores(x[r]), sizes, max(enough, k + 1)):
                    by.setdefault(i, []).append(j)
                for i, js in by.items():
                    for s in range(blocks[i]):
                        at.append(r)
                        first.append(i)
                        block.append(s)
                        second.append(js)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(first, pa.int32()), pa.array(block, pa.int32()), pa.array(second, pa.list_(pa.int32()))], ["node", "vec", "c1", "block", "cells"])

    index_cells = range(len(index.second))

    def reranked(stored: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if stored.num_rows and asking.num_rows:
            e, q = _matrix(stored.column("vec").combine_chunks(), dim), _matrix(asking.column("vec").combine_chunks(), dim)
            c2 = stored.column("c2").to_numpy()
            ids = stored.column("ids").to_pylist()
            low = np.array([x[0] for x in ids])
            nodes, visited = asking.column("node").to_pylist(), asking.column("cells").to_pylist()
            for r, (node, own) in enumerate(zip(nodes, visited)):
                if r % AT_ONCE == 0:
                    product = q[r : r + AT_ONCE] @ e.T
                reach = np.zeros(len(index_cells), dtype=bool)
                reach[own] = True
                some = np.flatnonzero(reach[c2])
                near = product[r % AT_ONCE, some]
                if len(some) > 2 * k + 16:
                    cut = np.partition(near, -(k + 1))[-(k + 1)]
                    some = some[near >= cut - 1e-9 * max(1.0, abs(cut))]
                exact = (e[some] * q[r]).sum(axis=1)
                best = np.lexsort((low[some], -exact))[: k + 1]
                pairs = sorted((-float(exact[p]), i) for p in best for i in ids[some[p]])[: k + 1]
                out[0].append(node)
                out[1].append([-s for s, _ in pairs])
                out[2].append([i for _, i in pairs])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())))], ["node", "scores", "found"])

    asking = materialize(asked.select("node").distinct(), "asking")
    slices = -(-max(asking.count(), 1) // ASKING)
    queries = asking.join(cells.select("node", "vec"), "node").mapInArrow(walked, f"node long, vec {element}, c1 int, block int, cells array<int>")
    many = spark.createDataFrame([(i, int(m)) for i, m in enumerate(blocks)], "c1 int, blocks int")
    dealt = cells.join(F.broadcast(many), "c1").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).select("vec", "ids", "c1", "c2", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(slices)).cast("int"))
    part = dealt.groupBy("c1", "block", "part").cogroup(queries.groupBy("c1", "block", "part")).applyInArrow(reranked, "node long, scores array<double>, found array<long>")
    each = part.select("node", F.explode(F.arrays_zip("scores", "found")).alias("x")).select("node", F.col("x.scores").alias("score"), F.col("x.found").alias("vec_id"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))
    own = asked.join(top, "node").select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
