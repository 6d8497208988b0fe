"""Whitening of vectors by matrix-free block subspace iteration.

1. One pass counts the rows and sums their entries as whole numbers: an entry c is x = floor(1024 * c) + 100000.
2. Each further pass sends a block Q of at most BLOCK columns to the tasks, which return X'(XQ) of their centred rows;
   Spark adds these up by row of the result, so the driver gets d x BLOCK numbers and never a covariance matrix.
3. After each pass the block is made orthogonal (QR) and a Rayleigh-Ritz step finds the best vectors in the span of the
   blocks of the passes so far; beyond KEPT columns it starts again from the best of them. Plain powers of a single block
   would converge as (e17 / e8) per pass, which takes hundreds of passes on vectors without a clear direction.
4. The iteration ends when the residuals |V a - e a| of all k components are at most TOLERANCE of the largest variance; a
   pass over the k vectors alone then certifies them. ``Whitening.residual`` holds what it found.

Defined cases: vectors that are null or hold null or non-finite entries have no rows in the result. All vectors must have
one length; rows of another length than the most frequent one (ties: the longer) are left out like null vectors. Rows that
repeat a vec_id, or have none, count and stay as rows of their own. There are as many components as have a variance above
rounding (none for a single row, for equal rows or an empty table). Entries beyond 2^52 / 1024 are held at that bound. A
deviation that no long can hold is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE, SHIFT = 1024.0, 100000
K = 8
#: Columns of a block, and of the span that a Rayleigh-Ritz step looks at.
BLOCK, KEPT = 16, 96
TOLERANCE = 1e-13
PASSES = 400
#: Smaller variances than this share of the largest one are rounding.
NOTHING = 1e-12
ROWS = 4096


@dataclass
class Whitening:
    """What ``fit`` learns: rows, sums of x by dimension, unit vectors as columns, their variances and the sum of all."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float
    residual: float = 0.0
    passes: int = 0


def _whole(col: pa.Array, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with a usable vector and their x, by vector length (only ``d`` if given), at most ROWS at once."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = col.values.slice(off[0], off[-1] - off[0])
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become nan
    off = off - off[0]
    size = np.diff(off)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fit = (bad[off[1:]] == bad[off[:-1]]) & col.is_valid().to_numpy(zero_copy_only=False)
    for length in np.unique(size[fit]) if d is None else [d]:
        rows = np.flatnonzero(fit & (size == length))
        for a in range(0, len(rows), ROWS):
            at = rows[a : a + ROWS]
            x = values[off[at][:, None] + np.arange(length)]
            yield at, np.clip(np.floor(x * SCALE), -(2.0**52), 2.0**52).astype(np.int64) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in whole numbers."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) >= 1 << 62:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums


def _squares(dev: np.ndarray) -> list[int | None]:
    """The sum of the squares of each row, exact; null beyond a long."""
    if dev.dtype != object and (not dev.size or max(abs(int(dev.min())), abs(int(dev.max()))) ** 2 * dev.shape[1] < 1 << 63):
        return (dev * dev).sum(axis=1).tolist()
    told = [sum(int(v) ** 2 for v in row) for row in dev]
    return [t if t < 1 << 63 else None for t in told]


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).cast("array<double>").alias("v"))


def _counted(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and sums of x of the most frequent vector length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in _whole(batch.column(0)):
                told = held.setdefault(x.shape[1], np.zeros(x.shape[1] + 1, np.int64))
                told += np.concatenate([[len(at)], x.sum(axis=0)])
        for d, told in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(d + 1)), pa.array(told)], names=["d", "slot", "value"])

    per = saved(vectors.mapInArrow(count, "d long, slot long, value long").groupBy("d", "slot").agg(F.sum("value").alias("value")))
    most = per.where("slot = 0").orderBy(F.desc("value"), F.desc("d")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    sums = {r["slot"]: r["value"] for r in per.where((F.col("d") == most["d"]) & (F.col("slot") > 0)).collect()}
    return most["value"], np.array([sums[i] for i in range(1, most["d"] + 1)], np.int64)


def _applied(vectors: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q for the covariance V of x, and its trace, from one pass over the vectors."""
    d, p = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, squares, some = np.zeros((d, p)), 0.0, False
        for batch in batches:
            for _, x in _whole(batch.column(0), d):
                c = _deviations(x, n, sums).astype(np.float64) / n
                product += c.T @ (c @ q)
                squares += float((c * c).sum())
                some = True
        if some:
            rows = np.vstack([product, np.full((1, p), squares)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), *[pa.array(rows[:, j]) for j in range(p)]], names=["slot", *[f"q{j}" for j in range(p)]])

    parts = vectors.mapInArrow(multiply, "slot long, " + ", ".join(f"q{j} double" for j in range(p)))
    out = np.zeros((d + 1, p))
    for r in parts.groupBy("slot").agg(*[F.sum(f"q{j}").alias(f"q{j}") for j in range(p)]).collect():
        out[r["slot"]] = r[1:]
    return out[:d] / n, float(out[d, 0] / n)


def _fresh(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of ``basis``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        kept = np.linalg.norm(block, axis=0) > 1e-10
        block = block[:, kept] / np.linalg.norm(block[:, kept], axis=0)
        if block.shape[1]:
            q, r = np.linalg.qr(block)
            block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block[:, : basis.shape[0] - basis.shape[1]]


def fit(df: DataFrame, vector: str = "embedding", k: int = K, block: int = BLOCK, kept: int = KEPT) -> Whitening:
    """The mean and the first ``k`` components of all vectors of ``df``."""
    vectors = _vectors(df, vector)
    n, sums = _counted(vectors)
    d = len(sums)
    if not n or not d:
        return Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    k, block = min(k, d), min(max(block, k), d)
    draw = np.random.default_rng(d)
    todo = _fresh(np.zeros((d, 0)), np.eye(d) if block == d else draw.standard_normal((d, block)))
    basis, image, total, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0.0, 0
    while True:
        product, total = _applied(vectors, n, sums, todo)
        passes += 1
        basis, image = np.hstack([basis, todo]), np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        values, ritz, moved = values[::-1], basis @ turn, image @ turn
        off = moved - ritz * values
        worst = np.linalg.norm(off[:, :k], axis=0).max()
        done = worst <= TOLERANCE * max(values[0], 0.0) or passes >= PASSES
        if not done:
            if basis.shape[1] + block > max(kept, k + 2 * block) and basis.shape[1] < d:
                few = k + block
                basis, image = ritz[:, :few], moved[:, :few]
            # where residuals are at rest before all k are certain, new directions come by chance
            todo = _fresh(basis, off[:, :block])
            if not todo.shape[1] and basis.shape[1] < d:
                todo = _fresh(basis, draw.standard_normal((d, block)))
            done = not todo.shape[1]
        if done:
            break
    axes = np.linalg.qr(ritz[:, :k])[0]
    product, total = _applied(vectors, n, sums, axes)
    small = axes.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, axes, product = values[::-1], axes @ turn[:, ::-1], product @ turn[:, ::-1]
    residual = float(np.linalg.norm(product - axes * values, axis=0).max())
    real = values > NOTHING * max(values[0], 0.0)
    return Whitening(n, sums, axes[:, real], values[real], total, residual, passes + 1)


def _projected(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    dev = _deviations(x, w.n, w.sums)
    return dev, (dev.astype(np.float64) / w.n) @ w.axes / np.sqrt(w.variances)


def identity_error(df: DataFrame, w: Whitening, vector: str = "embedding") -> float:
    """The largest entry by which the covariance of all whitened vectors differs from the identity."""
    d, k = w.axes.shape
    if not k:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _whole(batch.column(0), d):
                white = _projected(x, w)[1]
                sums += np.vstack([white.T @ white, white.sum(axis=0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), *[pa.array(sums[:, j]) for j in range(k)]], names=["slot", *[f"c{j}" for j in range(k)]])

    parts = _vectors(df, vector).mapInArrow(add, "slot long, " + ", ".join(f"c{j} double" for j in range(k)))
    out = np.zeros((k + 1, k))
    for r in parts.groupBy("slot").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).collect():
        out[r["slot"]] = r[1:]
    mean = out[k] / w.n
    return float(np.abs(out[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(df: DataFrame, w: Whitening, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained: one row for each usable vector and component."""
    d, k = w.axes.shape
    kind = df.schema[id_column].dataType.simpleString()
    share = w.variances / w.total if k else np.zeros(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _whole(batch.column(1), d) if k else ():
                dev, white = _projected(x, w)
                of = np.repeat(np.arange(len(at)), k)
                ids = batch.column(0).take(pa.array(at)).take(pa.array(of))
                squares = pa.array(_squares(dev), pa.int64()).take(pa.array(of))
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(component), pa.array(np.full(len(of), w.n)), squares, pa.array(white.ravel()), pa.array(np.tile(share, len(at)))],
                    names=[id_column, "component", "n", "deviation", "whitened", "explained"],
                )

    rows = df.select(F.col(id_column), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(project, f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double")
