"""Embedding near-dedup by an epsilon grid order join.

1. Vectors are scaled to unit length: cosine >= 0.95 is distance <= EPSILON = sqrt(2 - 2 * 0.95). Equal vectors are one
   class with a count before anything is compared.
2. Unit vectors are rotated to their principal axes (the summed outer products of all vectors, one matrix per vector
   length) and range-sorted by the grid cells of side EPSILON on the leading axes. The sequence is cut into blocks.
3. Pairs of intervals of the sequence are joined recursively: a pair of intervals whose bounding boxes lie more than
   EPSILON apart is dropped, any other gives the pairs of its children, down to pairs of blocks.
4. The two blocks of a pair are compared tile by tile with matrix products of the unit vectors as they are (rotated ones
   only serve bounds), again skipping tiles whose boxes are too far apart. A pair of blocks gives the number of links of each vector and the edges of a spanning forest, never the links
   themselves, so a large group of near copies stays linear in rows.
5. The forests' edges become components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows of a
null vec_id, whose component is null and which are not kept. Vectors of different lengths never link. A vec_id that
occurs in several rows counts as several vectors. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import Forest, connected_components

COSINE = 0.95
EPSILON = float(np.sqrt(2 - 2 * COSINE))
#: Axes whose cells order the sequence and bound its intervals.
AXES = 8
BLOCK = 4096
TILE = 1024
#: Children of an interval.
FAN = 8


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False), off


def _by_length(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vector length of a list column: the length, the rows' numbers and their unit vectors."""
    values, off = _lists(col)
    size = np.diff(off)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = values[(off[at][:, None] + np.arange(d)[None, :])].astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield int(d), at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each vector length, leading ones first. Sums are made per task, then per matrix row."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                sums[d] = sums.get(d, 0) + one.T @ one
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array([r.tobytes() for r in s], pa.binary())], names=["d", "i", "row"])

    def add(key, pdf):
        import pandas as pd

        return pd.DataFrame({"d": [key[0]], "i": [key[1]], "row": [np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0).tobytes()]})

    rows = classes.select("vector").mapInArrow(outer, "d int, i int, row binary").groupBy("d", "i").applyInPandas(add, "d int, i int, row binary").collect()
    out = {}
    for d in {r["d"] for r in rows}:
        m = np.zeros((d + 1, d + 1))
        for r in rows:
            if r["d"] == d:
                m[r["i"]] = np.frombuffer(r["row"])
        mean = m[d, :d] / m[d, d]
        out[d] = np.ascontiguousarray(np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))[1][:, ::-1])
    return out


_BOX = ", ".join(f"lo{k} double, hi{k} double" for k in range(AXES))


def _blocks(classes: DataFrame):
    """part, seq, d, n, h1, h2, m, y (unit vectors; arrays as bytes) and the box on the leading axes, written to the shared
    folder; and the broadcast axes."""
    axes = classes.sparkSession.sparkContext.broadcast(_axes(classes))

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(3)):
                y = x @ axes.value[d]
                cells = np.floor(y[:, :AXES] / EPSILON).astype(np.int32)
                if cells.shape[1] < AXES:
                    cells = np.pad(cells, ((0, 0), (0, AXES - cells.shape[1])))
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), d, np.int32)), *[pa.array(np.ascontiguousarray(cells[:, k])) for k in range(AXES)], *[batch.column(c).take(rows) for c in range(3)], pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["d", *[f"c{k}" for k in range(AXES)], "h1", "h2", "m", "y"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            d = rows.column("d")[0].as_py()
            raw = b"".join(rows.column("y").to_pylist())
            y = np.frombuffer(raw).reshape(-1, d) @ axes.value[d][:, :AXES]
            lo, hi = np.zeros(AXES), np.zeros(AXES)
            lo[: y.shape[1]], hi[: y.shape[1]] = y.min(axis=0), y.max(axis=0)
            seq += 1
            own = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False).tobytes() for c in ("h1", "h2", "m")]
            return pa.RecordBatch.from_pylist(
                [dict(part=part, seq=seq - 1, d=d, n=rows.num_rows, h1=own[0], h2=own[1], m=own[2], y=raw) | {f"lo{k}": lo[k] for k in range(AXES)} | {f"hi{k}": hi[k] for k in range(AXES)}],
                schema=schema,
            )

        fields = [("part", pa.int32()), ("seq", pa.int32()), ("d", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("h1", "h2", "m", "y")]]
        schema = pa.schema(fields + [(f"{s}{k}", pa.float64()) for k in range(AXES) for s in ("lo", "hi")])
        for batch in batches:
            d = batch.column("d").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(d)) + 1, [len(d)]])
            for i, j in zip(edges, edges[1:], strict=False):
                while i < j:
                    if held and held[0].column("d")[0].as_py() != d[i]:
                        yield block(pa.Table.from_batches(held))
                        held, n = [], 0
                    take = min(BLOCK - n, j - i)
                    held.append(batch.slice(i, take))
                    n, i = n + take, i + take
                    if n == BLOCK:
                        yield block(pa.Table.from_batches(held))
                        held, n = [], 0
        if held:
            yield block(pa.Table.from_batches(held))

    cells = [f"c{k}" for k in range(AXES)]
    turned = classes.select("h1", "h2", "m", "vector").mapInArrow(rotate, f"d int, {', '.join(f'{c} int' for c in cells)}, h1 long, h2 long, m long, y binary")
    keys = ["d", *cells, "h1", "h2"]
    return axes, saved(turned.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(cut, f"part int, seq int, d int, n int, h1 binary, h2 binary, m binary, y binary, {_BOX}"))


def _interval_pairs(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks with their place ``pos`` in the sequence, and the pairs (a, b) of places that may hold links."""
    parts = blocks.groupBy("part").agg(F.count("*").alias("blocks"))
    from pyspark.sql import Window

    ahead = parts.select("part", (F.sum("blocks").over(Window.orderBy("part")) - F.col("blocks")).alias("ahead"))
    placed = blocks.join(ahead, "part").withColumn("pos", F.col("ahead") + F.col("seq"))
    boxes = [c for k in range(AXES) for c in (f"lo{k}", f"hi{k}")]
    leaf = saved(placed.select("pos", "d", *boxes))
    total = leaf.count()
    levels = [leaf.select("pos", F.col("d").alias("d_lo"), F.col("d").alias("d_hi"), *boxes)]
    while total > 1:
        total = -(-total // FAN)
        up = levels[-1].groupBy(F.floor(F.col("pos") / FAN).cast("long").alias("pos"))
        levels.append(saved(up.agg(F.min("d_lo").alias("d_lo"), F.max("d_hi").alias("d_hi"), *[F.min(f"lo{k}").alias(f"lo{k}") for k in range(AXES)], *[F.max(f"hi{k}").alias(f"hi{k}") for k in range(AXES)])))
    pairs = levels[-1].select(F.col("pos").alias("a"), F.col("pos").alias("b"))
    for level in reversed(levels[:-1]):
        x = level.select(F.floor(F.col("pos") / FAN).cast("long").alias("a"), *[F.col(c).alias(f"x_{c}") for c in level.columns])
        y = level.select(F.floor(F.col("pos") / FAN).cast("long").alias("b"), *[F.col(c).alias(f"y_{c}") for c in level.columns])
        gap = sum((F.greatest(F.lit(0.0), F.col(f"x_lo{k}") - F.col(f"y_hi{k}"), F.col(f"y_lo{k}") - F.col(f"x_hi{k}")) ** 2 for k in range(AXES)), F.lit(0.0))
        near = (gap <= EPSILON**2 + 1e-9) & (F.col("x_d_lo") <= F.col("y_d_hi")) & (F.col("y_d_lo") <= F.col("x_d_hi"))
        pairs = saved(pairs.join(x, "a").join(y, "b").where((F.col("x_pos") <= F.col("y_pos")) & near).select(F.col("x_pos").alias("a"), F.col("y_pos").alias("b")))
    return placed, pairs


def compare(x: np.ndarray, y: np.ndarray, m_x: np.ndarray, m_y: np.ndarray, same: bool, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of x and of y to the other block's rows (weighted by their counts), and least labels of all rows.
    Tiles are bounded by boxes along ``axes``."""
    to_x, to_y, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), Forest(len(x) + len(y))
    bounds = lambda v: [(i, v[i : i + TILE].min(axis=0), v[i : i + TILE].max(axis=0)) for i in range(0, len(v), TILE)]
    tiles_y = bounds(y @ axes)
    for i, lo, hi in bounds(x @ axes):
        for j, lo2, hi2 in tiles_y:
            if same and j < i:
                continue
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            if (gap * gap).sum() > EPSILON**2 + 1e-9:
                continue
            near = x[i : i + TILE] @ y[j : j + TILE].T >= COSINE
            if same and i == j:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            p, q = np.nonzero(near)
            to_x[i : i + TILE] += np.bincount(p, m_y[j + q], near.shape[0]).astype(np.int64)
            if not (same and i == j):
                to_y[j : j + TILE] += np.bincount(q, m_x[i + p], near.shape[1]).astype(np.int64)
            forest.add(i + p, j + q if same else len(x) + j + q)
    return to_x, to_y, forest.label


def _links(placed: DataFrame, pairs: DataFrame, axes) -> DataFrame:
    """node, links (of this pair of blocks), root: a row of the block pair with the least node it is linked to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["d"] != r["d2"]:
                    continue
                x, y = (np.frombuffer(r[c]).reshape(-1, r["d"]) for c in ("y", "y2"))
                m_x, m_y = (np.frombuffer(r[c], np.int64) for c in ("m", "m2"))
                same = r["a"] == r["b"]
                to_x, to_y, label = compare(x, y, m_x, m_y, same, axes.value[r["d"]])
                node = np.concatenate([r["a"] * BLOCK + np.arange(len(x)), r["b"] * BLOCK + np.arange(len(y))])
                links = np.concatenate([to_x + to_y if same else to_x, np.zeros_like(to_y) if same else to_y])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[label[at]])], names=["node", "links", "root"])

    sides = [placed.select(F.col("pos").alias(c), "d" if k == 0 else F.col("d").alias("d2"), F.col("m").alias("m2" if k else "m"), F.col("y").alias("y2" if k else "y")) for k, c in enumerate("ab")]
    flip = (F.col("a") + F.col("b")) % 2 == 1
    dealt = pairs.select(F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"))
    return saved(dealt.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "node long, links long, root long"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    valid = F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = raw.withColumn("valid", valid).withColumns({"h1": F.when(F.col("valid"), F.xxhash64("vector")), "h2": F.when(F.col("valid"), F.xxhash64(F.lit(1), "vector"))})
    classes = saved(keyed.where("valid").groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.any_value("vector").alias("vector")))
    rows = keyed.select("vec_id", "h1", "h2")
    if classes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    axes, blocks = _blocks(classes)
    placed, pairs = _interval_pairs(blocks)
    found = _links(placed, pairs, axes)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node <> root"), "node", "root")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(r["pos"] * BLOCK + np.arange(r["n"])), *[pa.array(np.frombuffer(r[c], np.int64)) for c in ("h1", "h2")]], names=["node", "h1", "h2"])

    nodes = placed.select("pos", "n", "h1", "h2").mapInArrow(members, "node long, h1 long, h2 long")
    named = nodes.join(classes.select("h1", "h2", "m", "least"), ["h1", "h2"]).join(counts, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
    named = saved(named.select("h1", "h2", "m", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("links") + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
