"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import bpe_round_trip
from .common import table
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .langid import fit_language_model, identify
from .lm import score_documents
from .ngram_join import jaccard_components
from .packing import pack_documents
from .pii import pseudonymize
from .sharding import shard_by_bytes


def vocabulary() -> str:
    """Where the public byte-level BPE vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(n: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


#: The key of the surrogates in the registered queries; a deployment passes its own secret.
PII_KEY = "spanloom-demo-key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, PII_KEY, count_col="n_mentions")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), 2048)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold(5) != 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(fold(4) != 2))
    held = docs.withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    return identify(held, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_exact_dedup, op3_sharding, op4_html_extraction, op5_ngram_jaccard_join, op6_best_fit_packing, op7_bpe, op8_nearest_neighbours, op9_lm_scoring, op10_language_id)}


OP2_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
