import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def jaccard(a, b):
    """The share of runs of five words that two texts have in common."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / max(1, len(x | y))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    # copies whose lines break elsewhere: no line repeats, so they are left to the near-duplicate stage
    flat = F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"((?:\S+ ){9})", "$1\n")
    again = docs.where("lang = 'en' AND length(text) > 1500").withColumns({"doc_id": F.col("doc_id") + 1_000_000, "text": flat})
    docs = docs.union(again.select(docs.columns))
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL)
        assert docs.columns[: len(columns)] == columns
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = docs.cache()
            assert 0 < docs.count()
            if k in (0, 2):
                assert docs.count() < n
            if k == 1:
                assert docs.where(~F.col("text").rlike(r"[\p{L}\p{N}]")).count() == 0
            if k == 2:  # of texts that are alike one stays
                left = {r.doc_id for r in docs.collect()}
                pairs = [i for i in texts if i + 1_000_000 in texts and jaccard(texts[i], texts[i + 1_000_000]) > 0.85]
                assert pairs and not [i for i in pairs if {i, i + 1_000_000} <= left]
            texts = {r.doc_id: r.text for r in docs.collect()}
            n = docs.count()
    assert docs.where("not round_trip").count() == 0 and docs.count() == n
