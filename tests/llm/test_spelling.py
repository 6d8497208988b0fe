"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from matchweave.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n")
    out = spelling.variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_equals_all_pairs(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(5, 8))) for _ in range(300)]
    words += ["aaaaa", "aaaaaa", "ababab", "bababa", "ÀÈÌÒÙ", "àèìòù", "aaaaaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaaab"]
    docs = [(i, " ".join(draw.choice(words[: draw.choice((20, 100, 308))]) for _ in range(60))) for i in range(120)]
    docs += [(None, "Hello HELLO hello×hello"), (7, None), (8, ""), (9, "docs " * 3 + "words; words\twords\nWords")]
    want = brute(docs)
    assert len(want) > 200 and any(r[2] != (r[1] or r[0]) for r in want)
    assert got(spark, docs) == want


def test_the_deleted_letter(spark):
    """Among many documents some occurrences lose the letter that the checksum names."""
    docs = [(i, "letters letters") for i in range(3000)]
    want = brute(docs)
    assert len(want) > 1 and got(spark, docs) == want


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "one two")]) == []
