"""The pipeline's stages against what each should do to its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.common import materialize


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    seen = [docs]
    for name, f in corpus_pipeline.STAGES:
        seen.append(materialize(f(spark, seen[-1], sf), name))
    first, lang, exact, near, pii, packed = seen
    assert [x.columns for x in seen[1:5]] == [docs.columns] * 4
    assert {r.doc_id for r in first.select("doc_id").exceptAll(lang.select("doc_id")).collect()} == {10**6, 10**6 + 1}
    assert exact.count() == lang.select("text").distinct().count() == exact.select("text").distinct().count()
    assert 0 < near.count() <= exact.count() and near.exceptAll(exact).count() == 0
    assert pii.count() == near.count() and not any(re.search(r"@mail\d\.example\.com", r.text) for r in pii.collect())
    assert packed.select("doc_id").distinct().count() == pii.count() and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert corpus_pipeline.run(spark, sf).count() > 0
