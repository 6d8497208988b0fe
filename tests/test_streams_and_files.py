import json
import subprocess
import sys

from pyspark.sql import functions as F

from matchweave.sources import readers, writers
from matchweave.streaming import stateful


def calls(spark, n=60):
    return spark.range(n).select(F.col("id").alias("call_id"), (F.col("id") % 3).alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"))


def test_stream_equals_batch(spark, tmp_path):
    rows = calls(spark)
    batch = {r.call_id: r.allowed for r in stateful.rate_limited(rows, 3, 100).collect()}
    for k in range(3):  # three files, read one a batch
        rows.where(F.col("call_id").between(20 * k, 20 * k + 19)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stateful.rate_limited_stream(stream, 3, 100).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.call_id: r.allowed for r in spark.table("limited").collect()} == batch
    assert 0 < sum(batch.values()) < len(batch)


def test_fresh_clicks(spark, tmp_path):
    rows = calls(spark).select(F.col("key").alias("app_id"), "ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stateful.fresh_clicks_stream(stream).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.app_id, r.seen, r.fresh) for r in spark.table("fresh").collect()} == {(k, 20, 20) for k in range(3)}


def test_files(spark, tmp_path):
    log = tmp_path / "clicks.json"
    log.write_text(json.dumps([{"app_id": "a", "target": "github", "url": "u", "ts": "2024-01-01T00:00:00Z"}, {"target": "x"}]))
    assert [r.app_id for r in readers.click_log(spark, str(log)).collect()] == ["a"]
    sheet = tmp_path / "roster.csv"
    sheet.write_text("﻿ Name ,Minimum  Score Threshold\nDana,80\n".replace("﻿", ""))
    assert readers.roster_csv(spark, str(sheet)).columns == ["name", "minimum_score_threshold"]
    old = tmp_path / "pool.json"
    old.write_text(json.dumps([{"url": "http://a", "text": "t", "title": "x", "ts": "2024-01-01"}, {"url": " ", "text": "t"}, {"url": "http://a", "text": "later", "ts": "2024-01-02"}]))
    empty = spark.createDataFrame([], "url string")
    assert [r.text for r in readers.legacy_pool(spark, str(old), empty).collect()] == ["t"]
    assert readers.legacy_pool(spark, str(old), spark.createDataFrame([("http://b",)], "url string")).count() == 0
    batch = spark.createDataFrame([(1, "http://a", "x" * 6000, "t"), (2, "http://a", "y", "t"), (3, "ftp://c", "y", "t"), (4, "http://b", "y", "t"), (5, "http://d", None, "t")], "seq long, url string, text string, title string")
    pool = spark.createDataFrame([("http://b",)], "url string")
    assert {r.seq: r.outcome for r in writers.classified(batch, pool).collect()} == {1: "saved", 2: "duplicate", 3: "skipped", 4: "duplicate", 5: "skipped"}
    assert [len(r.text) for r in writers.insertable(batch, pool).collect()] == [5000]
    out = str(tmp_path / "out")
    writers.write_quoted_csv(spark.createDataFrame([('a "b"', None)], "x string, y string").coalesce(1), out)
    assert any('"a ""b"""' in p.read_text() for p in (tmp_path / "out").glob("part-*.csv"))


def test_entry_imports_without_the_llm_parts():
    code = "import sys; sys.modules['matchweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'ledger_balances' in q and set(e.oracle_sql()) <= set(q)"
    root = __file__.rsplit("/tests/", 1)[0]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
