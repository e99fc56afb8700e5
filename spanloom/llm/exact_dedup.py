"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Every text becomes a SHA-256 digest; digests and ids are written once (about 100 bytes a row), so
   that texts are read and hashed a single time.
2. A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``; mergeable, built map-side,
   at most ``tracked`` counters) names the digests that can be frequent.  Its error is at most 3.5 N / tracked, so no
   digest with more copies than that is missed; any that is takes the shuffle of step 4, with the same result.
3. Exact counts verify them.  The winners, at most ``max_heavy`` rows, are broadcast and their groups
   are settled map-side, without a shuffle of their rows.
4. All other digests go through an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exactly, free_name, materialize


def digest(column) -> F.Column:
    """Lower-case hex SHA-256 of a text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def heavy_winners(digests: DataFrame, max_heavy: int = 4096, tracked: int = 16384, least: int = 32) -> DataFrame:
    """digest, keep_id (largest id), group_size of the frequent digests of (digest, id); at most ``max_heavy`` rows."""
    top = digests.agg(F.expr(f"approx_top_k(digest, {max_heavy}, {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).filter(F.col("t.count") >= least).select(F.col("t.item").alias("digest"))
    verified = (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter(F.col("group_size") >= least)
    )
    return materialize(verified, "winners")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 4096, tracked: int = 16384, least: int = 32) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  The row with the largest id stays.  Rows that
    repeat both id and text are one record: all carry the same ``kept``.  A null id loses to any other and
    is kept only in a group without ids.  An empty table gives an empty result; extra columns are not read.
    """
    digests = materialize(df.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    winners = heavy_winners(digests, max_heavy, tracked, least)
    split = digests.join(F.broadcast(winners), "digest", "left")
    heavy = split.filter("group_size is not null")
    group = Window.partitionBy("digest")
    light = split.filter("group_size is null").withColumns({"keep_id": F.max("id").over(group), "group_size": F.count("*").over(group)})
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_unique(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 4096, tracked: int = 16384, least: int = 32) -> DataFrame:
    """The rows of ``df`` that stay, all columns: of equal texts the one with the largest id.

    Copies of frequent texts go map-side, against the broadcast winners; of the rest, and of what repeats
    a winner's id, one row for each digest passes the shuffle's other side.
    """
    d = free_name(df, "digest")
    keyed = df.withColumn(d, digest(F.col(text_col)))
    digests = materialize(keyed.select(F.col(id_col).alias("id"), F.col(d).alias("digest")), "digests")
    winners = heavy_winners(digests, max_heavy, tracked, least).select(F.col("digest").alias(w := free_name(keyed, "w")), F.col("keep_id").alias(k := free_name(keyed, "k")))
    split = keyed.join(F.broadcast(winners), F.col(d) == F.col(w), "left").filter(F.col(w).isNull() | F.col(id_col).eqNullSafe(F.col(k)))
    n = free_name(split, "n")
    order = Window.partitionBy(d).orderBy(F.col(id_col).desc_nulls_last())
    return split.withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).select(*map(exactly, df.columns))
