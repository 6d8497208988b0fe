"""Whitening against numpy's eigenvectors of the whole covariance, on small tables."""

import numpy as np
import pytest

from matchweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 9) for i, v in rows], SCHEMA).repartition(3)


def by_hand(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, a = np.linalg.eigh(c.T @ c / n)
    e, a = e[::-1][:k], a[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ a / np.sqrt(e), e / (c * c).sum() * n


def compare(spark, vectors, k=8, **options):
    df = frame(spark, list(enumerate(vectors)))
    model = whitening.fit(df, k=k, **options)
    out = whitening.whitened(df, model).toPandas().sort_values(["vec_id", "component"])
    deviation, white, share = by_hand(vectors, k)
    assert out.n.eq(len(vectors)).all() and out[out.component == 1].deviation.tolist() == deviation.tolist()
    got = out.whitened.to_numpy().reshape(len(vectors), k)
    assert np.abs(got * np.sign((got * white).sum(axis=0)) - white).max() < 1e-8
    assert np.allclose(out.explained.to_numpy().reshape(-1, k)[0], share, rtol=1e-10)
    assert whitening.identity_error(df, model) < 1e-10 and model.residual < 1e-10 * model.total
    return model


def test_equals_eigenvectors_of_the_covariance(spark):
    draw = np.random.default_rng(1)
    compare(spark, draw.standard_normal((200, 20)) * np.linspace(1, 3, 20))


def test_long_vectors_need_restarts(spark):
    draw = np.random.default_rng(2)
    model = compare(spark, draw.standard_normal((400, 90)) * 1.02 ** np.arange(90), block=8, kept=32)
    assert model.passes > 5


def test_fewer_dimensions_than_components(spark):
    draw = np.random.default_rng(3)
    compare(spark, draw.standard_normal((50, 3)) * [1, 2, 3], k=3)
    df = frame(spark, list(enumerate(draw.standard_normal((50, 3)))))
    assert whitening.fit(df).axes.shape == (3, 3)


def test_unusable_vectors_and_ties(spark):
    good = [[1, 0, 0.5], [0, 1, 0], [0, 0, 2], [3, 1, 1], [3, 1, 1]]
    rows = [(1, good[0]), (None, good[1]), (2, good[2]), (2, good[3]), (3, good[4])]
    bad = [(4, None), (5, [1, None, 2]), (6, [1, float("nan"), 2]), (7, [float("inf"), 0, 0]), (8, []), (9, [1, 2])]
    df = frame(spark, rows + bad)
    model = whitening.fit(df)
    out = whitening.whitened(df, model)
    assert model.n == 5 and sorted((r.vec_id or 0) for r in out.where("component = 1").collect()) == [0, 1, 2, 2, 3]
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained"]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_varies(spark, rows):
    df = frame(spark, rows)
    model = whitening.fit(df)
    assert model.axes.shape[1] == 0 and whitening.whitened(df, model).count() == 0 and whitening.identity_error(df, model) == 0


def test_equal_directions(spark):
    """Only one direction varies: one component."""
    df = frame(spark, [(i, [i, 2 * i, 0.0]) for i in range(10)])
    model = whitening.fit(df)
    assert model.axes.shape == (3, 1) and abs(model.variances[0] / model.total - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    vectors = [[float(1 << 38), 1.0], [-float(1 << 38), 2.0], [0.0, 3.0]]
    df = frame(spark, list(enumerate(vectors)))
    model = whitening.fit(df)
    out = whitening.whitened(df, model).where("component = 1").orderBy("vec_id").collect()
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for v in vectors]
    want = [sum((3 * c - sum(col)) ** 2 for c, col in zip(r, zip(*x, strict=True), strict=True)) for r in x]
    assert [r.deviation for r in out] == [w if w < 1 << 63 else None for w in want]
