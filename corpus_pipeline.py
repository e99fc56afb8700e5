"""A training corpus from raw documents: language ID, exact and near dedup, PII surrogates, packing.

Each stage works on all documents that the one before kept, and is judged on its own input.  All but the
last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, table
from spanloom.llm.exact_dedup import keep_unique
from spanloom.llm.langid import fit_language_model, keep_identified
from spanloom.llm.ngram_join import jaccard_components
from spanloom.llm.packing import pack_documents
from spanloom.llm.pii import pseudonymize
from spanloom.llm.queries import PII_KEY, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model learnt from the labelled ones; the rejected go."""
    return keep_identified(docs, fit_language_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return keep_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links join, the document with the least doc_id."""
    groups = jaccard_components(docs)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    return pseudonymize(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences of at most 2048."""
    return pack_documents(docs, vocabulary(), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("pii", pii),
    ("best_fit_packing", packing),
]

#: Neither the trained classifier nor the tokenizer can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name, tidy=True)
    return STAGES[-1][1](spark, docs, sf_dir)
