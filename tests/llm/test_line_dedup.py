"""Plans of line dedup."""

from pyspark.sql import functions as F

from matchweave.llm import line_dedup


def test_filters_on_deduped_texts_do_not_copy_the_split_into_lambdas(spark):
    rows = [(i, "\n".join(f"line {j % 7} of text" for j in range(i * 3))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.dedup_lines(docs, "removed", min_words=1).where(~((F.col("removed") > 0) & ~F.col("text").rlike("[a-z]")))
    # the text and the count, each in the filter and in the result
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
    assert sorted((r.doc_id, r.text, r.removed) for r in out.collect()) == [(0, "", 0), (1, rows[1][1], 0), (2, "\n".join(rows[2][1].split("\n")[3:]), 3), (3, "line 6 of text", 8)]
