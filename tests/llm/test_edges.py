"""Nulls in any column, clashing names and empty tables, for the operators of the pipeline and the pipeline itself."""

import pytest

from matchweave.llm import mixing, near_dedup

WORDS = "one two three four five six seven eight nine ten eleven twelve"


def rows(spark, n=12):
    docs = [(i if i % 4 else None, None if i == 5 else f"{WORDS} number {i % 7}\n{WORDS}", "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 2}", i) for i in range(1, n + 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS copy", "2 AS position", "3 AS size", "4 AS target", "5 AS taken", "6 AS __row", "7 AS __extra", "8 AS lines", "9 AS kept", "10 AS component", "11 AS evidence", "12 AS `a.b`")


def test_mix_keeps_columns_of_any_name(spark):
    df = rows(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert all((r.copy, r.position, r.size, r.target, r.taken, r["__row"], r["a.b"]) == (1, 2, 3, 4, 5, 6, 12) for r in out.collect())


def test_null_ids_are_kept_by_near_dedup(spark):
    df = spark.createDataFrame([(None, WORDS), (2, WORDS), (3, WORDS), (None, None)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert out == [(0, 0, True), (0, 0, True), (2, 2, True), (3, 2, False)]
    assert sorted((r.doc_id or 0) for r in near_dedup.keep_one(df).collect()) == [0, 0, 2]


@pytest.mark.parametrize("n", [12, 0])
def test_pipeline(spark, tmp_path, n):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = rows(spark, n).drop("a.b")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == rows(spark).drop("a.b").columns
        docs.count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert all(r.round_trip for r in out.collect()) and out.columns[: len(docs.columns)] == docs.columns
