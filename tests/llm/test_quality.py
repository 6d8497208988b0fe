import numpy as np

from matchweave.llm import quality as Q

RNG = np.random.default_rng(6)
GOOD = [f"word{i}" for i in range(80)]


def corpus(n):
    out, labels = [], []
    for i in range(n):
        site = f"s{i % 3}"
        bad, toxic = (i * 7) % 10 < (6 if site == "s2" else 1), i % 6 == 0
        text = " ".join(w + ("%%%" if bad else "") for w in RNG.choice(GOOD, 60)) + (" idiot" if toxic else "") + "."
        out.append((i, text, "en", site, len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return out, labels


def test_posteriors(spark):
    rows, labels = corpus(400)
    rows += [(900, None, None, None, 0), (901, "", "en", "s1", 0), (902, "!!!", None, "s1", 3), (1, rows[1][1], "en", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS q_path")
    lab = spark.createDataFrame(labels[:200] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.posteriors(df, lab).collect()}
    for i, q, t in labels:
        assert out[i].keep == bool(q and not t), i
    assert out[0].site_quality > out[2].site_quality  # the third site is worse
    assert not any(out[i].keep for i in (900, 901, 902))
    kept = Q.kept_documents(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.keep for r in Q.posteriors(df, lab).collect())


def test_sparse_paths_shrink_to_their_site(spark):
    rows = [("a", "x", 1.0, -9.0)] * 50 + [("a", "y", -5.0, -9.0)] + [("b", "x", 1.2, -9.0)] * 40 + [("c", "x", 0.8, -9.0)] * 40
    table, base = Q.rates(spark.createDataFrame(rows, "__site string, __path string, q double, t double"))
    got = {(r["__site"], r["__path"]): r for r in table.collect()}
    sparse = got[("a", "y")]
    raw = 1 / (1 + np.exp(5))
    assert raw < sparse.q_path < sparse.q_site and abs(got[("a", "x")].q_path - 1 / (1 + np.exp(-1))) < 0.05
    assert 0 < base["q"] < 1


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some words", "en", "s")], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.posteriors(df, lab).first().keep
    assert Q.posteriors(df.limit(0), lab).count() == 0
