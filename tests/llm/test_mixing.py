import hashlib
import re
from collections import defaultdict

import pytest

from matchweave.llm import mixing as M


def rows():
    out = [(i, "w " * (1 + i * 7 % 40), f"s{i % 4}", 5) for i in range(200)]
    return out + [(500, None, "s1", 5), (501, "", None, 5), (502, "a b c\x0bd", None, 5), (502, "a b c\x0bd", None, 5), (None, "x y", "s2", 5)]


def brute(data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in data:
        by[r[2]].append((r[0], size(r[1])))
    order = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    held = {s: sum(n for _, n in by[s]) for s in by}
    target, open_, left = {}, set(by), sum(held.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * held[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * held[s]
            left -= 3 * held[s]
        open_ -= over
    out = []
    for s, docs in by.items():
        docs.sort(key=lambda d: ("" if d[0] is None else hashlib.md5(str(d[0]).encode()).hexdigest(), d[0] or 0, d[1]))
        rest, before = round(target[s] - int(target[s] / held[s]) * held[s]) if held[s] else 0, 0
        for i, n in docs:
            full = int(target[s] / held[s]) * n if held[s] else 0
            out.append((str(i), n, held[s], round(target[s], 6), full + max(0, min(n, rest - before))))
            before += n
    return sorted(out)


def test_targets_and_taken(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, taken int")
    got = M.curriculum(df).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(rows())
    assert all(r.taken <= 3 * r.size and (len(r.positions) > 0) == (r.taken > 0) and list(r.positions) == sorted(r.positions) for r in got)


def test_training_order(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, taken int")
    out = M.training_order(M.curriculum(df)).collect()
    places = [r.position for r in out]
    assert places == sorted(places)
    words, taken = defaultdict(int), defaultdict(int)
    for r in out:
        words[r.source] += len(re.findall(M.WORD, r.text))
    for r in M.curriculum(df).collect():
        taken[r.source] += r.taken
    assert {k: v for k, v in taken.items() if v} == dict(words)
    # the first source starts heavy: half of its words come before a third of the time
    first = [r.position for r in out if r.source == "s0"]
    assert sorted(first)[len(first) // 2] < 0.4


def test_position_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for schedule in M.SCHEDULES + ((0.0, 2.0, 0.0),):
        df = spark.range(11).select((F.col("id") / 10).alias("u")).select("u", M.position_of(F.col("u"), F.array(*map(F.lit, map(float, schedule)))).alias("t"))
        for r in df.collect():
            n, done = len(schedule) - 1, 0.0
            for k in range(n):
                x = min(max(r.t * n - k, 0), 1)
                done += (schedule[k] * x + (schedule[k + 1] - schedule[k]) * x * x / 2) / n
            assert done / M.integral(schedule) == pytest.approx(r.u, abs=1e-9)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.curriculum(df).count() == 0 and M.training_order(M.curriculum(df)).count() == 0
    none = spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")
    assert M.curriculum(none).first().taken == 0
