"""Exact n-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

1. One pass over the texts makes each distinct shingle set (numpy).  Slices of texts send their hashes to
   blocks of the hash space, packed 7 bytes a shingle; copies within a slice are sent once.
2. A block counts in how many sets each shingle occurs and returns those of two or more to their slice.
   A shingle of one set can't link, so the rest of a set, known by number, is first in the rare-first order.
3. A set whose prefix holds only such shingles has no partner and drops out: only near-duplicates remain.
4. Sets that remain meet on their prefix shingles.  A few rounds compare each set with the most central set
   that it meets, verified once a pair; what these link is one component.  Then all pairs that still
   meet across components, pass the filters and were not linked are verified.  So no link between
   components is lost, and a large group of near copies is not expanded into its pairs.

Sets are named by a 64-bit hash of their shingles; one that two different sets share has odds of
about (number of sets) squared / 2**65.  Sizes are counted over 64-bit hashes of shingles, overlaps over
their upper 56 bits; a pair of sets is misjudged at odds of about (size of their union) squared / 2**57.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, release, remove
from .components import connected_components
from .shingles import mix64, shingle_hashes, slices

BYTES_A_BLOCK = 12 << 20
ROUNDS = 3
SENT = "home int, block int, slice long, counts binary, tokens binary, fps binary, ids binary"
BACK = "slice long, counts binary, tokens binary, dfs binary, fps binary, ids binary"
SETS = "id long, node long, n long, singles long, score double, tokens binary, prefix binary"


def _needed(n):
    """The least overlap that a set of ``n`` shingles shares with any partner at 0.75."""
    return -(-3 * n // 4)


def _pack(tokens: np.ndarray) -> bytes:
    """The upper seven bytes of each hash."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    """Hashes as they were packed, with zero for the lowest byte."""
    out = np.zeros((len(packed) // 7, 8), dtype=np.uint8)
    out[:, 1:] = np.frombuffer(packed, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _send(k: int, blocks: int):
    """Texts to packed shingle hashes by block, and one row of each slice with its sets' names."""

    def run(batches):
        number, partition = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False).astype(np.int64)
                name = (partition << 32) | number
                number += 1
                h, ends = shingle_hashes(texts, k)
                n = np.diff(ends)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h + np.uint64(0x51)), dtype=np.uint64)])
                fp = np.where(n > 0, mix64((sums[ends[1:]] - sums[ends[:-1]]) + n.astype(np.uint64)), np.uint64(0)).view(np.int64)
                _, first, which = np.unique(fp, return_index=True, return_inverse=True)
                of = np.zeros(len(fp), dtype=bool)
                of[first] = n[first] > 0
                doc = np.repeat(np.arange(len(n)), n)
                keep = of[doc]
                h, doc = h[keep], np.cumsum(of)[doc[keep]] - 1
                sets = int(of.sum())
                block = ((h >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                h, doc, block = h[order], doc[order], block[order]
                present, start = np.unique(block, return_index=True)
                stop = np.append(start[1:], len(block))
                counts = [np.bincount(doc[x:y], minlength=sets).astype(np.uint32).tobytes() for x, y in zip(start, stop)]
                tokens = [_pack(h[x:y]) for x, y in zip(start, stop)]
                m = len(present)
                head = np.stack([fp[of], n[of]]).astype(np.int64).tobytes()
                members = np.stack([ids, fp, n]).astype(np.int64).tobytes()
                none = pa.array([None] * m + [head], pa.binary()), pa.array([None] * m + [members], pa.binary())
                home = [int(b) for b in present] + [int(name % blocks)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home, pa.int32()), pa.array([*map(int, present), -1], pa.int32()), pa.array([name] * (m + 1), pa.int64()), pa.array([*counts, None], pa.binary()), pa.array([*tokens, None], pa.binary()), *none],
                    ["home", "block", "slice", "counts", "tokens", "fps", "ids"],
                )

    return run


def _count(table: pa.Table) -> pa.Table:
    """Within one block: the shingles that two sets or more hold, back to their slices."""
    release()
    rows = table.to_pylist()
    heads = [r for r in rows if r["block"] < 0]
    parts = [r for r in rows if r["block"] >= 0]
    del rows
    names = ["slice", "counts", "tokens", "dfs", "fps", "ids"]
    kinds = [pa.int64(), *[pa.binary()] * 5]
    out: list[tuple] = [(r["slice"], None, None, None, r["fps"], r["ids"]) for r in heads]
    if parts:
        tokens = np.concatenate([_unpack(r["tokens"]) for r in parts])
        order = np.argsort(tokens)
        ordered = tokens[order]
        new = np.ones(len(ordered), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        run = np.cumsum(new) - 1
        df = np.empty(len(tokens), dtype=np.uint32)
        df[order] = np.bincount(run).astype(np.uint32)[run]
        del order, ordered, new, run
        at = 0
        for r in parts:
            counts = np.frombuffer(r["counts"], np.uint32)
            own = slice(at, at + len(r["tokens"]) // 7)
            at = own.stop
            shared = df[own] > 1
            if shared.any():
                doc = np.repeat(np.arange(len(counts)), counts)
                out.append((r["slice"], np.bincount(doc[shared], minlength=len(counts)).astype(np.uint32).tobytes(), _pack(tokens[own][shared]), df[own][shared].tobytes(), None, None))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def _gather(table: pa.Table) -> pa.Table:
    """Of one slice: every document's set (id, node, n) and the sets that may have partners."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["fps"] is not None)
    fps, ns = np.frombuffer(head["fps"], np.int64).reshape(2, -1)
    ids, nodes, sizes = np.frombuffer(head["ids"], np.int64).reshape(3, -1)
    parts = [r for r in rows if r["fps"] is None]
    out = [[*ids.tolist()], [*nodes.tolist()], [*sizes.tolist()], [None] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)]
    if parts:
        doc = np.concatenate([np.repeat(np.arange(len(fps)), np.frombuffer(r["counts"], np.uint32)) for r in parts])
        tokens = np.concatenate([_unpack(r["tokens"]) for r in parts])
        dfs = np.concatenate([np.frombuffer(r["dfs"], np.uint32) for r in parts])
        m = np.bincount(doc, minlength=len(fps))
        alive = (m >= _needed(ns)) & (ns > 0)
        keep = alive[doc]
        doc, tokens, dfs = doc[keep], tokens[keep], dfs[keep]
        order = np.lexsort((tokens, dfs, doc))
        doc, tokens, dfs = doc[order], tokens[order], dfs[order]
        for d in np.flatnonzero(alive):
            x, y = np.searchsorted(doc, [d, d + 1])
            n, singles = int(ns[d]), int(ns[d] - m[d])
            held = n - _needed(n) + 1 - singles
            score = (singles + float((1.0 / dfs[x:y]).sum())) / n
            for column, value in zip(out, (None, int(fps[d]), n, singles, score, np.sort(tokens[x:y]).tobytes(), tokens[x : x + held].tobytes())):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["id", "node", "n", "singles", "score", "tokens", "prefix"])


def _postings(batches):
    """One row for each prefix shingle: its position in the set's rare-first order counts the single ones."""
    for b in batches:
        cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "singles", "score")}
        prefix = [np.frombuffer(x, np.int64) for x in b.column("prefix").to_pylist()]
        many = np.array([len(x) for x in prefix], dtype=np.int64)
        of = np.repeat(np.arange(len(prefix)), many)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + cols["singles"].astype(np.int64)[of]
        tokens = np.concatenate(prefix) if len(of) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens), pa.array(cols["node"].astype(np.int64)[of]), pa.array(cols["n"].astype(np.int64)[of]), pa.array(pos), pa.array(cols["score"].astype(np.float64)[of])], ["token", "node", "n", "pos", "score"]
        )


def _may_link(n1, p1, n2, p2) -> F.Column:
    """Length and positional filters, from sizes and positions of a shared shingle; lossless at a pair's first one."""
    need = F.ceil(F.lit(3) * (n1 + n2) / F.lit(7.0))
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= need)


def _checked(batches):
    """The pairs that link: a suffix filter over quarters of the hash space, then the exact overlap."""
    quarters = np.array([1 << 62, 1 << 63, 3 << 62], dtype=np.uint64)
    for b in batches:
        ok = np.zeros(b.num_rows, dtype=bool)
        cols = [b.column(c).to_pylist() for c in ("n1", "n2", "t1", "t2")]
        last, x, cuts_x = None, None, None
        for i, (n1, n2, t1, t2) in enumerate(zip(*cols)):
            if t1 is not last:
                last, x = t1, np.frombuffer(t1, np.uint64)
                cuts_x = np.diff(np.concatenate([[0], np.searchsorted(x, quarters), [len(x)]]))
            y = np.frombuffer(t2, np.uint64)
            need = -(-3 * (n1 + n2) // 7)
            cuts_y = np.diff(np.concatenate([[0], np.searchsorted(y, quarters), [len(y)]]))
            if np.minimum(cuts_x, cuts_y).sum() >= need:
                both = np.concatenate([x, y])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * overlap >= 75 * (n1 + n2 - overlap)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    two = pairs.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("tokens").alias("t2")), "b")
    both = two.join(sets.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("tokens").alias("t1")), "a")
    return both.select("a", "b", "n1", "n2", "t1", "t2").mapInArrow(lean(_checked), "a long, b long")


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    return postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Labels after new edges: components of the old components."""
    if labels is not None:
        a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    new = connected_components(edges)
    if labels is None:
        return materialize(new, "labels")
    up = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return materialize(old.unionByName(new.join(labels, "node", "left_anti")), "labels")


def jaccard_components(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col (integer), n_shingles and component_id of every row.

    Sets link at a Jaccard similarity of 0.75 or more; component_id is the least id that links reach.  Null,
    empty and wordless texts have no shingles, link with nothing and are their own component.  A null
    id takes part but is never a component's id, unless no other is there.  Equal sets are one node, so copies cost no pairs; repeated rows give
    repeated results; extra columns aren't read.  An empty table gives an empty result.  ``df`` must give the same rows in the
    same order when it is read again, as a stored table does: slices of a partition are named by their place in it.
    """
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(64, -(-size // BYTES_A_BLOCK))
    sent = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(_send(k, blocks)), SENT)
    back = sent.groupBy("home").applyInArrow(_count, BACK)
    found = materialize(back.groupBy("slice").applyInArrow(_gather, SETS), "sets", tidy=True)
    del sent, back
    members = materialize(found.filter("tokens is null").select("id", "node", "n"), "members")
    sets = materialize(found.filter("tokens is not null").drop("id").dropDuplicates(["node"]), "nodes", tidy=True)
    remove(df.sparkSession, found.spanloom_path)
    postings = materialize(sets.mapInArrow(lean(_postings), "token long, node long, n long, pos long, score double"), "postings")
    labels, tried = None, None
    for turn in range(ROUNDS + 1):
        own = _labelled(postings, labels)
        rank = F.col("score") if turn == 0 else F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(1 << 20)) + F.col("score") / 2
        own = own.withColumn("rank", rank.cast("double"))
        meet = own.groupBy("token").agg(F.min(F.struct("rank", "node", "n", "pos", "label")).alias("top"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
        if turn < ROUNDS:
            near = own.join(meet, "token").filter((F.col("label") != F.col("top.label")) & _may_link(F.col("n"), F.col("pos"), F.col("top.n"), F.col("top.pos")))
            pairs = near.groupBy("node").agg(F.min(F.struct("top.rank", "top.node")).alias("best")).select(F.col("best.node").alias("a"), F.col("node").alias("b"))
        else:
            mixed = own.join(meet.select("token"), "token").select("token", "node", "n", "pos", "label")
            other = mixed.select("token", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "label")))
            met = mixed.join(other, "token").filter((F.col("label") < F.col("label2")) & _may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
            pairs = met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
        # each pair is verified once: one that failed in a round isn't tried in a later one
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        edges = materialize(_verified(pairs, sets), "links", tidy=True)
        if edges.isEmpty():
            continue
        labels = _merge(labels, edges)
    # the least id of a component from the least ids of its sets; copies of a set are many rows, but one row here
    own_id = F.when(F.col("id") != -(1 << 63), F.col("id"))
    per_set = materialize(members.filter("n > 0").groupBy("node").agg(F.min(own_id).alias("low"), F.count("*").alias("copies")), "per_set")
    if labels is None:
        named = per_set.select("node", F.col("low").alias("least"), "copies")
    else:
        tops = materialize(per_set.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "tops")
        least = tops.groupBy("label").agg(F.min("low").alias("least"))
        named = materialize(tops.join(least, "label").select("node", "least", "copies"), "named")
    # sets of many copies, of which there can be few, meet their rows map-side
    many = named.filter(F.col("copies") * 1000 >= max(members.count(), 100_000)).select("node", "least")
    out = members.withColumn("node", F.when(F.col("n") > 0, F.col("node")))
    hot = out.join(F.broadcast(many), "node")
    rest = out.join(F.broadcast(many.select("node")), "node", "left_anti").join(named.select("node", "least"), "node", "left")
    return hot.unionByName(rest).select(own_id.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", own_id).alias("component_id"))
