import ctypes
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchweave.llm import quality, sentence_pieces

TEXT = "The quick brown fox jumps over the lazy dog, and 12 others (of 345) follow it. "


def _own_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def _freed_memory(batches):
    """How much of a worker's memory it has freed but not given back."""
    for _ in batches:
        pass
    before = _own_mb()
    ctypes.CDLL(None).malloc_trim(0)
    held = before - _own_mb()
    time.sleep(0.3)  # for every worker to get a task
    yield pa.RecordBatch.from_arrays([pa.array([held])], names=["mb"])


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_workers_give_memory_back_after_encoding(spark):
    held = lambda: [r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(_freed_memory, "mb double").collect()]
    held()  # what other tests have left
    docs = spark.range(0, 1600, 1, 16).select(F.col("id").alias("doc_id"), F.repeat(F.lit(TEXT), 300).alias("text"))
    assert sentence_pieces.encoded_documents(docs).where("round_trip").count() == 1600
    assert max(held()) < 8


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_workers_give_memory_back_after_scoring(spark):
    held = lambda: [r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(_freed_memory, "mb double").collect()]
    held()
    model = quality.Model([quality.Head(np.zeros(quality.WORD_BUCKETS, np.float32), np.zeros(quality.RATIOS), 0.0)] * 2, np.zeros(quality.RATIOS), np.ones(quality.RATIOS))
    docs = spark.range(0, 1600, 1, 16).select(F.repeat(F.lit(TEXT + "\n"), 300).alias("text"))
    assert docs.select(quality.scorer(docs, model)("text").alias("s")).where("s.words > 0").count() == 1600
    assert max(held()) < 8


def test_batches_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    sentence_pieces.encoded_documents(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))).collect()
    sent = [r.n for r in spark.range(0, 2000, 1, 1).select(F.repeat(F.lit(TEXT), 100).alias("text")).mapInArrow(sizes, "n long").collect()]
    assert sum(sent) > 15_000_000 and max(sent) < 6_000_000


def test_the_table_of_pieces_needs_no_python_workers(spark):
    words = spark.createDataFrame(pa.table({"word": ["ab"], "n": [1]}))
    assert "ExistingRDD" not in sentence_pieces.lattice(words, sentence_pieces.Pieces.load())._jdf.queryExecution().toString()


def test_a_filter_on_scores_does_not_score_twice(spark):
    model = quality.Model([quality.Head(np.zeros(quality.WORD_BUCKETS, np.float32), np.zeros(quality.RATIOS), 0.0)] * 2, np.zeros(quality.RATIOS), np.ones(quality.RATIOS))
    docs = spark.createDataFrame(pa.table({"text": ["a b\n"]}))
    kept = docs.withColumn("s", quality.scorer(docs, model)("text")).where("s.words > 0").select("s.q", "s.t")
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
