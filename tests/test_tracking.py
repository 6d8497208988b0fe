"""Gates and edits of tracked jobs by hand; a gate's stream under cuts."""

import datetime as dt

import pytest

from matchweave.operators import journeys
from matchweave.streaming import stateful

AT = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
ATTEMPTS = [(1, 1, 0, False), (2, 1, 1, True), (3, 1, 60, True), (4, 1, 61, False), (5, 1, 62, None), (6, 1, 63, True), (7, 2, 5, True), (8, None, 5, True), (9, 2, None, True), (10, 2, 30, False)]
OUTCOMES = {1: "failed", 2: "renewed", 3: "fresh", 4: "failed", 5: "failed", 6: "renewed", 7: "renewed", 10: "fresh"}
KIND = "attempt_id long, key long, ts timestamp, ok boolean"


def _rows(rows):
    return [(i, k, None if t is None else AT(t), ok) for i, k, t, ok in rows]


def test_gate(spark):
    df = spark.createDataFrame(_rows(ATTEMPTS), KIND)
    assert {r.attempt_id: r.outcome for r in stateful.gated(df, 3600).collect()} == OUTCOMES
    assert stateful.gated(df.limit(0), 3600).count() == 0


@pytest.mark.parametrize("cuts", [(3,), (1, 2, 4, 5)])
def test_gate_of_a_stream(spark, tmp_path, cuts):
    rows = [r for r in _rows(ATTEMPTS) if r[1] is not None]
    source = str(tmp_path / "in")
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        spark.createDataFrame(rows[a:b], KIND).coalesce(1).write.mode("append").parquet(source)
    got = {}
    stream = stateful.gated_stream(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source), 3600)
    q = stream.writeStream.foreachBatch(lambda df, _: got.update({r.attempt_id: r.outcome for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == OUTCOMES


def test_edits_of_tracked_jobs(spark):
    rows = [
        (1, "add", 10, "u", "viewed"), (2, "add", 11, "u", "viewed"), (3, "sent", None, "u", None), (4, "status", 10, None, "submitted"), (5, "delete", 11, None, None), (6, "referral", None, "u", "pending"),
        (7, "referral", None, "u", "accepted"), (8, "sent", None, None, None), (9, "status", 11, None, "late"), (10, "add", 12, None, "viewed"), (11, "sent", None, "v", None), (12, "add", 10, "w", "again"), (13, "delete", None, None, None),
    ]
    df = spark.createDataFrame([(i, 1, AT(i), *r) for i, *r in rows], "entry_id long, user_id long, ts timestamp, kind string, job_id long, url string, value string")
    got = {r.entry_id: r.job_id for r in journeys.tracked_edits(df).collect()}
    assert got == {1: 10, 2: 11, 3: 11, 4: 10, 5: 11, 6: 10, 7: 10, 8: None, 9: None, 10: 12, 11: None, 12: None, 13: None}
    left = {r.job_id: (r.status, r.sent, r.referral) for r in journeys.tracked_jobs(df).collect()}
    assert left == {10: ("submitted", False, "accepted"), 12: ("viewed", False, None)}
