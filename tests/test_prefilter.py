from matchweave.operators import prefilter
from matchweave.plans import catalog


def test_every_text_meets_every_profile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefilter, "PROFILES", 2)
    items = [(1, "alpha bravo gamma delta omega with"), (2, "only three wordlets"), (3, "zulu yankee xray whisky victor"), (3, "alpha bravo gamma delta omega"), (4, None), (45, "alpha bravo gamma delta quux")]
    docs = [(1, "ALPHAbravo"), (2, "alpha bet"), (41, "xgamma deltas"), (7, None), (8, "yankeezulu quux omega alpha")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.item_id: r.passed for r in catalog.QUERIES["text_prefilter_all"](spark, str(tmp_path)).collect()}
    assert out == {1: 3, 2: 5, 3: 1 + 3, 45: 3}
