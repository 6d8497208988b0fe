"""The keyword prefilter of every profile against every text.

A keyword is four or more of a-z, so a text contains it if one of the text's runs of a-z does. Each run is looked up once
per task (by its parts, in a table of the keywords); a batch of texts is then one matrix product with the profiles' words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions import text as T

#: Profiles that are held at once, texts of one product, and runs that a task remembers.
PROFILES = 1024
TEXTS = 256
RUNS = 1 << 17
_RUN = re.compile("[a-z]{4,}")


def _passes(texts: DataFrame, profiles: list) -> DataFrame:
    place = {w: k for k, w in enumerate(sorted({w for p in profiles for w in p["words"]}))}
    table = np.zeros((len(place), len(profiles)), np.float32)
    for j, p in enumerate(profiles):
        table[[place[w] for w in p["words"]], j] = 1
    always = np.array([len(p["words"]) < 5 for p in profiles])
    shared = texts.sparkSession.sparkContext.broadcast((place, table, always))
    ids = [p["item_id"] for p in profiles]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table, always = shared.value
        longest = max(map(len, place), default=0)
        known: dict[str, list[int]] = {}
        total = np.zeros(len(always), np.int64)

        def held(run: str) -> list[int]:
            if run not in known:
                if len(known) >= RUNS:
                    known.clear()
                parts = {run[i:j] for i in range(len(run) - 3) for j in range(i + 4, min(len(run), i + longest) + 1)}
                known[run] = [place[w] for w in parts if w in place]
            return known[run]

        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            has = np.zeros((batch.num_rows, len(place)), np.float32)
            for i, low in enumerate(batch.column(0).to_pylist()):
                for run in set(_RUN.findall(low or "")):
                    has[i, held(run)] = 1
            total += ((has @ table >= 2) | always).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "passed"])

    counts = texts.select(F.lower("text").alias("low")).mapInArrow(count, "k int, passed long")
    return counts.where("passed > 0").select(F.element_at(F.lit(ids) if ids else F.array(), F.col("k") + 1).alias("item_id"), "passed")


def passed(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, passed: how many of all ``texts`` (text) pass the prefilter of each of ``items`` (item_id, text)."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), T.keywords(F.col("text")).alias("words")).where("item_id is not null and words is not null")
    blocks, block = [], []
    for row in words.toLocalIterator():
        block.append(row)
        if len(block) == PROFILES:
            blocks.append(_passes(texts, block))
            block = []
    if block or not blocks:
        blocks.append(_passes(texts, block))
    out = blocks[0]
    for more in blocks[1:]:
        out = out.union(more)
    return out.groupBy("item_id").agg(F.sum("passed").alias("passed"))
