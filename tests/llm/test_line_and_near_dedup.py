import itertools
import re

import numpy as np

from matchweave.llm import line_dedup, near_dedup

RNG = np.random.default_rng(4)
VOCABULARY = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def changed(text, n):
    w = text.split()
    for k in RNG.choice(len(w), n, replace=False):
        w[k] = f"x{RNG.integers(1000)}"
    return " ".join(w)


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_lines_against_brute_force(spark):
    long = [sentence(60) for _ in range(12)]
    docs = []
    for d in range(40):
        lines = [long[RNG.integers(12)] if RNG.random() < 0.3 else changed(long[RNG.integers(12)], RNG.integers(0, 3)) if RNG.random() < 0.5 else sentence(RNG.integers(1, 30)) for _ in range(6)]
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, "short line"), (104, "short line")]
    seen, want = [], {}
    for d, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            s = shingles(line)
            if len(re.findall(r"\w+", line)) >= 5:
                if any(len(s & t) * 5 >= 4 * len(s | t) for t in seen):
                    seen.append(s)
                    continue
                seen.append(s)
            kept.append(line)
        want[d] = "\n".join(kept)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS lines", "2 AS token")
    out = line_dedup.dedup_lines(df, "removed").collect()
    assert {r.doc_id: r.text for r in out} == want and out[0].lines == 1
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_documents_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAVY", 20)
    monkeypatch.setattr(near_dedup, "GROUP", 4)
    base = [sentence(120) for _ in range(15)]
    docs = [(i, changed(base[i % 15], int(RNG.integers(0, 4)))) for i in range(90)]
    docs += [(200 + i, base[0]) for i in range(30)] + [(300, None), (301, ""), (302, "!!"), (303, "two words"), (304, "two words"), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS keys", "2 AS class_id")
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    comp = {i: i for i, _ in docs}
    pairs = [(a, b) for (a, s), (b, t) in itertools.combinations(docs, 2) if shingles(s or "") and len(shingles(s) & shingles(t or "")) >= 0.82 * len(shingles(s) | shingles(t or ""))]
    for _ in range(10):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    # documents that are clearly similar share a component; those of different origin never do
    assert all(out[i] == out[comp[i]] for i in comp)
    origin = lambda i: i % 15 if i < 90 else 0 if i < 300 else 303 if i in (303, 304) else i
    assert all(origin(i) == origin(out[i]) for i in out)
    kept = near_dedup.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == {i for i in out if out[i] == i} and kept.columns == df.columns
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
