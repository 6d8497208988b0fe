import numpy as np

from matchweave.llm import embedding_join as E


def brute(rows):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v) and rows[k][0] is not None}
    ok = {k: v / np.abs(v).max() for k, v in ok.items()}
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= E.COSINE:
                links[a].add(b)
    comp = {k: rows[k][0] for k in links}
    changed = True
    while changed:
        changed = False
        for a in links:
            for b in links[a]:
                if comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sorted((str(rows[k][0]), len(links[k]), str(comp[k])) for k in links)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "TILE", 8)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 6))
    rows = [(int(i), (base[i % 25] + rng.normal(0, 0.12, 6)).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [1.0, 0.0]), (306, [2.0, 0.0]), (307, [1e200, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (5, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS m")
    out = E.near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in E.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
