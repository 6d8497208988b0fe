"""Helpers shared by the operators: table access, saved intermediate tables, summed statistics tables."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []
#: Bytes of the batches that go to Python, about: by rows alone a batch of long texts has no bound, and the JVM and each worker hold it.
BATCH_BYTES = 1 << 22
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session within one machine (tests) may leave
    it unset; it then gets a new folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        path = _OWN[0]
    return path.rstrip("/")


def _trim() -> None:
    """Gives freed memory of the driver's Python back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on the session cuts what it sends to Python into batches of about BATCH_BYTES, unless its user has set a size."""
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task, after which the worker gives freed memory back to the system: an executor keeps idle workers of past stages,
    and the C library and Arrow's allocator of each would keep the memory of its largest batches."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()  # of all that was allocated with malloc, numpy's arrays too

    return run


def saved(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends here and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _trim()
    return spark.read.schema(df.schema).parquet(path)


def summed_table(df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], length: int, chunks: int = 16) -> np.ndarray:
    """Adds up one array of ``length`` counts per task over all rows of ``df``.

    ``fill(batch, counts)`` adds a batch to the task's counts. The result has a fixed size whatever the
    input, so the driver and every worker may hold it. Counts are summed in ``chunks`` tasks.
    """
    step, widths = -(-length // chunks), {1: "<u1", 2: "<u2", 4: "<i4", 8: "<i8"}

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, some = np.zeros(step * chunks, np.int64), False
        for batch in batches:
            some = True
            fill(batch, counts)
        if some:
            parts = counts.reshape(chunks, step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(chunks), pa.int32()), pa.array([p.astype(next(kind for kind in widths.values() if p.max() <= np.iinfo(kind).max)).tobytes() for p in parts], pa.binary())],
                names=["chunk", "counts"],
            )

    def add(key, pdf):
        import pandas as pd

        total = np.zeros(step, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, widths[len(b) // step])
        return pd.DataFrame({"chunk": [key[0]], "counts": [total.tobytes()]})

    rows = df.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    out = np.zeros(step * chunks, np.int64)
    for r in rows:
        out[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out[:length]


def free_name(names: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that no column has, whatever the case."""
    taken = {n.lower() for n in names}
    while wanted in taken:
        wanted += "_"
    return wanted


def with_newline(text: str) -> F.Column:
    """The text, empty if null, with a line end: no word or line runs over into the next row of a batch."""
    return F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
