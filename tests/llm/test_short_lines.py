import corpus_pipeline
from matchweave.llm import line_dedup, queries

ROWS = [(1, "Les.\nAnd ornd.\n\n---\na line of five words"), (2, "les\nnew one\n\n---\nAnd ornd."), (3, "new two\nLes.\na line of five words\nnew one"), (4, None)]
WANT = {1: ROWS[0][1], 2: "new one\n\n---", 3: "new two", 4: ""}


def test_repeated_short_lines_go(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, r.removed) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in out.items()} == WANT and {k: v[1] for k, v in out.items()} == {1: 0, 2: 2, 3: 3, 4: 0}
    assert {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, str(tmp_path)).collect()} == WANT


def test_null_ids_clashing_names_and_hot_prefixes(spark, monkeypatch):
    """Against brute force, where many lines share a rare beginning and few are similar."""
    monkeypatch.setattr(line_dedup, "HOT", 3)
    same = "the very same line of more than five words"
    docs = [(None, f"{same}\n{same}"), (None, None), (9, same), (10, f"a\n{same}\nb"), (10, "x y")]
    head = "permission is hereby granted to anyone at all who obtains"
    for k in range(30):
        tail = " ".join(f"t{k}x{j}" for j in range(40))
        docs.append((100 + k, f"{head} {tail}\n{head} {' '.join(tail.split()[:-1])} changed{k}"))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS lines", "3 AS parts", "4 AS bounds", "5 AS `a.b`")
    out = line_dedup.dedup_lines(df, "removed", min_words=1)
    assert out.columns == [*df.columns, "removed"]
    rows = out.collect()
    assert sorted(r.text for r in rows if r.doc_id is None) == ["", f"{same}\n{same}"]
    assert [(r.text, r.removed) for r in rows if r.doc_id == 9] == [(same, 0)]
    assert sorted(r.text for r in rows if r.doc_id == 10) == ["a\nb", "x"] or sorted(r.text for r in rows if r.doc_id == 10) == ["a\nb", "x y"]
    assert all(r.removed == 1 and r.text.endswith("39") for r in rows if r.doc_id and r.doc_id >= 100)


def test_three_words_in_all(spark, tmp_path):
    spark.createDataFrame([(1, "just three words"), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op8_line_dedup(spark, str(tmp_path)).collect())) == [(1, "just three words", 0), (2, "", 0)]
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, corpus_pipeline.dedup_lines(spark, df, str(tmp_path)).collect())) == [(1, "just three words"), (2, "")]
