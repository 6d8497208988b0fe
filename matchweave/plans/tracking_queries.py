"""Queries of gates, caches and edits of tracked jobs over the events, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchweave.operators import journeys
from matchweave.plans.inputs import table
from matchweave.plans.registry import query
from matchweave.streaming import stateful


def _gated(source: str, seconds: int) -> str:
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, attempt_id) AS rn FROM ({source}) WHERE key IS NOT NULL),
f AS (SELECT NULL::BIGINT AS attempt_id, key, 0::BIGINT AS rn, NULL::DOUBLE AS last, '' AS outcome FROM o WHERE rn = 1
  UNION ALL
  SELECT o.attempt_id, o.key, o.rn, CASE WHEN ok AND (last IS NULL OR sec - last >= {seconds}) THEN sec ELSE last END, CASE WHEN sec - last < {seconds} THEN 'fresh' WHEN ok THEN 'renewed' ELSE 'failed' END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
SELECT attempt_id, key, outcome FROM f WHERE rn > 0"""


@query("state_sync_gate", _gated("SELECT event_id AS attempt_id, user_id % 20 AS key, epoch_us(ts) / 1e6 AS sec, event_type <> 'error' AND event_id % 3 > 0 AS ok FROM events", 3600))
def state_sync_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS attempt_id", "user_id % 20 AS key", "ts", "event_type <> 'error' AND event_id % 3 > 0 AS ok")
    return stateful.gated(rows, 3600)


@query("state_ranking_cache", _gated("SELECT event_id AS attempt_id, user_id % 50 AS key, epoch_us(ts) / 1e6 AS sec, true AS ok FROM events WHERE event_type IN ('view', 'click')", 1200))
def state_ranking_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").selectExpr("event_id AS attempt_id", "user_id % 50 AS key", "ts", "true AS ok")
    return stateful.gated(rows, 1200)


_KIND = "CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'sent' WHEN 'purchase' THEN 'referral' WHEN 'error' THEN 'delete' ELSE 'status' END"
_URL = "CASE WHEN event_type IN ('view', 'click', 'purchase') AND event_id % 7 > 0 THEN 'https://a.b/' || event_id % 3 END"
_VALUE = "CASE event_type WHEN 'view' THEN 'viewed' WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'expired' END WHEN 'signup' THEN CASE event_id % 2 WHEN 0 THEN 'submitted' ELSE 'generated' END END"
_EDITS = f"""WITH e AS (SELECT event_id AS entry_id, user_id, ts, {_KIND} AS kind, {_URL} AS url, {_VALUE} AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
i AS (SELECT *, CASE WHEN kind IN ('add', 'status', 'delete') THEN max(CASE WHEN kind = 'add' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn) END AS job_rn FROM e),
d AS (SELECT user_id, job_rn, min(rn) FILTER (kind = 'delete') AS gone FROM i WHERE job_rn IS NOT NULL GROUP BY ALL),
a AS (SELECT i.user_id, i.rn, i.entry_id AS job_id, i.url, coalesce(d.gone, 1000000000000) AS gone FROM i JOIN d ON d.user_id = i.user_id AND d.job_rn = i.rn WHERE kind = 'add'),
o AS (SELECT i.entry_id, i.user_id, i.kind, i.rn, i.value, CASE WHEN kind IN ('sent', 'referral') THEN (SELECT arg_max(a.job_id, a.rn) FROM a WHERE a.user_id = i.user_id AND a.url = i.url AND a.rn < i.rn AND a.gone > i.rn)
  ELSE (SELECT a.job_id FROM a WHERE a.user_id = i.user_id AND a.rn = i.job_rn AND a.gone >= i.rn) END AS job_id FROM i)
"""


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, user_id, ts, kind, job_id, url, value; edits by id mean the user's last added job."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS entry_id", "user_id", "ts", f"{_KIND} AS kind", f"{_URL} AS url", f"{_VALUE} AS value")
    before = Window.partitionBy("user_id").orderBy("ts", "entry_id")
    newest = F.last(F.when(F.col("kind") == "add", F.col("entry_id")), ignorenulls=True).over(before)
    return e.withColumn("job_id", F.when(F.col("kind").isin("add", "status", "delete"), newest))


@query("tracked_edits", _EDITS + "SELECT entry_id, user_id, kind, job_id, value FROM o")
def tracked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.tracked_edits(edits(spark, sf_dir))


@query("tracked_jobs", _EDITS + """SELECT user_id, job_id, arg_max(value, rn) FILTER (kind IN ('add', 'status')) AS status, bool_or(kind = 'sent') AS sent, arg_max(value, rn) FILTER (kind = 'referral') AS referral
FROM o WHERE job_id IS NOT NULL GROUP BY ALL HAVING NOT bool_or(kind = 'delete')""")
def tracked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.tracked_jobs(edits(spark, sf_dir))
