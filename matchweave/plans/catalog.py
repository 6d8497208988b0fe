"""The registered queries over the shared tables and the same queries in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators import activity, directory, documents_cv, ledger, matcher, prefilter
from matchweave.plans import community_queries, fallback, inputs, named, page_queries, reassembly_queries, rewritten, streams, tracking_queries  # noqa: F401
from matchweave.plans.inputs import NOW, table, with_views
from matchweave.plans.registry import QUERIES, SQL, query  # noqa: F401
from matchweave.sources import readers, writers
from matchweave.streaming import stateful

# Ledger

BALANCES = with_views("ledger") + """SELECT c_custkey AS user_id, coalesce(sum(delta), 0)::BIGINT AS balance
FROM customer LEFT JOIN ledger ON user_id = c_custkey GROUP BY c_custkey"""


@query("ledger_balances", BALANCES)
def ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return ledger.balances(users, inputs.ledger(spark, sf_dir))


@query("ledger_daily_credits", with_views("ledger") + """SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS credits
FROM ledger WHERE action IN ('recruiter_added_new', 'recruiter_enriched', 'employee_added_new', 'employee_enriched') GROUP BY ALL""")
def ledger_daily_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_credits(inputs.ledger(spark, sf_dir))


@query("ledger_history", with_views("ledger") + """SELECT entry_id, user_id, delta,
  (sum(delta) OVER (PARTITION BY user_id ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM ledger""")
def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.history(inputs.ledger(spark, sf_dir))


@query("ledger_points_summary", with_views("ledger") + """SELECT coalesce(sum(delta) FILTER (delta > 0), 0)::BIGINT AS issued,
  abs(coalesce(sum(delta) FILTER (delta < 0), 0))::BIGINT AS spent, count(*) AS entries, count(DISTINCT user_id) AS users FROM ledger""")
def ledger_points_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.points_summary(inputs.ledger(spark, sf_dir))


@query("ledger_admitted_charges", "WITH RECURSIVE " + inputs.CTES["ledger"] + """,
o AS (SELECT entry_id, user_id, delta, row_number() OVER (PARTITION BY user_id ORDER BY ts, entry_id) AS rn FROM ledger WHERE user_id IS NOT NULL),
f AS (
  SELECT entry_id, user_id, delta, rn, delta >= 0 AS accepted, CASE WHEN delta >= 0 THEN delta ELSE 0 END AS balance FROM o WHERE rn = 1
  UNION ALL
  SELECT o.entry_id, o.user_id, o.delta, o.rn, o.delta >= 0 OR f.balance + o.delta >= 0,
         f.balance + CASE WHEN o.delta >= 0 OR f.balance + o.delta >= 0 THEN o.delta ELSE 0 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1
)
SELECT entry_id, user_id, delta, accepted, balance::BIGINT AS balance FROM f""")
def ledger_admitted_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admitted_charges(inputs.ledger(spark, sf_dir))


@query("ledger_capped_awards", "WITH RECURSIVE " + inputs.CTES["ledger"] + """,
o AS (SELECT entry_id, user_id, action || ':' || ref_id AS k, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, entry_id) AS rn
      FROM ledger WHERE action IN ('recruiter_added_new', 'recruiter_enriched', 'employee_added_new', 'employee_enriched')),
f AS (
  SELECT entry_id, user_id, rn, day, 'awarded' AS outcome, [k] AS seen, 1 AS n FROM o WHERE rn = 1
  UNION ALL
  SELECT o.entry_id, o.user_id, o.rn, o.day,
    CASE WHEN list_contains(f.seen, o.k) THEN 'repeat' WHEN CASE WHEN o.day = f.day THEN f.n ELSE 0 END >= 5 THEN 'capped' ELSE 'awarded' END,
    CASE WHEN list_contains(f.seen, o.k) OR CASE WHEN o.day = f.day THEN f.n ELSE 0 END >= 5 THEN f.seen ELSE list_append(f.seen, o.k) END,
    CASE WHEN o.day = f.day THEN f.n ELSE 0 END + CASE WHEN list_contains(f.seen, o.k) OR CASE WHEN o.day = f.day THEN f.n ELSE 0 END >= 5 THEN 0 ELSE 1 END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1
)
SELECT entry_id, user_id, outcome FROM f""")
def ledger_capped_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.capped_awards(inputs.ledger(spark, sf_dir))


@query("ledger_refunds", with_views("ledger") + """SELECT ref_id, user_id, entry_id, -delta AS refund FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ref_id ORDER BY ts DESC, entry_id DESC) AS rn FROM ledger WHERE delta < 0) WHERE rn = 1""")
def ledger_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.refunds(inputs.ledger(spark, sf_dir))


@query("ledger_monthly_usage", with_views("ledger") + """SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS uses FROM ledger GROUP BY ALL""")
def ledger_monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.monthly_usage(inputs.ledger(spark, sf_dir))


@query("ledger_openings", """WITH RECURSIVE o AS (SELECT event_id AS entry_id, user_id, CASE event_type WHEN 'signup' THEN 3 ELSE -1 END AS delta, event_id % 12 AS contact_id, event_id % 3 AS job,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('signup', 'click', 'view')),
f AS (SELECT 0::BIGINT AS entry_id, user_id, 0::BIGINT AS rn, 0 AS balance, []::VARCHAR[] AS seen, '' AS outcome FROM o WHERE rn = 1
  UNION ALL
  SELECT o.entry_id, o.user_id, o.rn, f.balance + CASE outcome2 WHEN 'credited' THEN delta WHEN 'opened' THEN -1 ELSE 0 END, CASE WHEN outcome2 = 'opened' THEN list_append(f.seen, k) ELSE f.seen END, outcome2
  FROM f, LATERAL (SELECT o.*, contact_id || ':' || job AS k, CASE WHEN delta > 0 THEN 'credited' WHEN contact_id >= 10 THEN 'unknown' WHEN list_contains(f.seen, contact_id || ':' || job) THEN 'repeat' WHEN f.balance < 1 THEN 'short' ELSE 'opened' END AS outcome2
    FROM o WHERE o.user_id = f.user_id AND o.rn = f.rn + 1) o)
SELECT entry_id, user_id, outcome, balance::BIGINT AS balance FROM f WHERE rn > 0""")
def ledger_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'click', 'view')")
    rows = e.select(F.col("event_id").alias("entry_id"), "user_id", "ts", F.when(F.col("event_type") == "signup", 3).otherwise(0).alias("credit"), (F.col("event_id") % 12).alias("contact_id"), (F.col("event_id") % 3).alias("job"))
    return ledger.openings(rows, spark.range(10).withColumnRenamed("id", "contact_id"))


@query("ledger_admin_stats", with_views("ledger", "directory_rows") + """SELECT 'recruiters' AS metric, 'total' AS part, count(*) AS n FROM directory_rows UNION ALL SELECT 'recruiters', 'verified', count(*) FILTER (verified) FROM directory_rows
UNION ALL SELECT 'action', action, count(*) FROM ledger GROUP BY action UNION ALL SELECT 'users', 'total', count(DISTINCT user_id) FROM ledger
UNION ALL SELECT 'points', 'issued', coalesce(sum(delta) FILTER (delta > 0), 0)::BIGINT FROM ledger UNION ALL SELECT 'points', 'spent', abs(coalesce(sum(delta) FILTER (delta < 0), 0))::BIGINT FROM ledger""")
def ledger_admin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.admin_stats(inputs.directory_rows(spark, sf_dir), inputs.ledger(spark, sf_dir))


# Activity


@query("activity_kpis", with_views("tracked") + """SELECT count(*) AS total, count(*) FILTER (status = 'submitted') AS submitted, count(*) FILTER (cv_generated) AS cv_generated,
  coalesce(round(avg(coalesce(score, 0))), 0)::BIGINT AS avg_score FROM tracked""")
def activity_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.kpis(inputs.tracked(spark, sf_dir))


@query("activity_funnel", with_views("tracked") + """, t AS (SELECT count(*) AS viewed, count(*) FILTER (score > 0) AS scored, count(*) FILTER (cv_generated) AS generated,
  count(*) FILTER (status = 'submitted') AS submitted FROM tracked),
u AS (SELECT viewed AS total, 'viewed' AS stage, viewed AS n FROM t UNION ALL SELECT viewed, 'scored', scored FROM t
  UNION ALL SELECT viewed, 'generated', generated FROM t UNION ALL SELECT viewed, 'submitted', submitted FROM t)
SELECT stage, n, CASE WHEN total > 0 THEN round(n * 100 / total) ELSE 0 END::BIGINT AS pct FROM u""")
def activity_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.funnel(inputs.tracked(spark, sf_dir))


@query("activity_platforms", with_views("tracked") + """, g AS (SELECT trim(CASE WHEN coalesce(platform, '') = '' THEN 'Other' ELSE platform END) AS platform, count(*) AS n, min(job_id) AS first_seen
  FROM tracked GROUP BY 1)
SELECT platform, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen)::INTEGER AS place FROM g""")
def activity_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.platforms(inputs.tracked(spark, sf_dir))


@query("activity_click_report", with_views("tracked", "clicks") + """,
g AS (SELECT app_id, target, count(*) AS n, min(click_id) AS first_click FROM clicks GROUP BY ALL),
l AS (SELECT app_id, sum(n)::BIGINT AS n_clicks, string_agg(CASE target WHEN 'github' THEN 'GitHub' WHEN 'linkedin' THEN 'LinkedIn' ELSE 'Portfolio' END, ', ' ORDER BY first_click) AS targets FROM g GROUP BY 1),
m AS (SELECT app_id, max(ts) AS last_click FROM clicks GROUP BY 1)
SELECT job_id, app_id, coalesce(n_clicks, 0) AS n_clicks, last_click, coalesce(targets, '') AS targets
FROM tracked LEFT JOIN l USING (app_id) LEFT JOIN m USING (app_id)""")
def activity_click_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.click_report(inputs.tracked(spark, sf_dir), inputs.clicks(spark, sf_dir))


@query("activity_newest_clicked", with_views("tracked", "clicks") + """SELECT job_id FROM tracked JOIN (SELECT app_id, max(ts) AS clicked FROM clicks GROUP BY 1) USING (app_id)
ORDER BY clicked DESC, job_id LIMIT 1""")
def activity_newest_clicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.newest_clicked(inputs.tracked(spark, sf_dir), inputs.clicks(spark, sf_dir))


@query("activity_new_clicks", with_views("clicks") + """SELECT app_id, count(*) - app_id % 20 AS fresh FROM clicks GROUP BY app_id HAVING count(*) > app_id % 20""")
def activity_new_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("app_id"), (F.col("c_custkey") % 20).alias("seen"))
    return activity.new_clicks(inputs.clicks(spark, sf_dir), seen)


@query("activity_recent_500", with_views("tracked") + "SELECT job_id, app_id, status, ts FROM tracked ORDER BY ts DESC, job_id DESC LIMIT 500")
def activity_recent_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.recent(inputs.tracked(spark, sf_dir).select("job_id", "app_id", "status", "ts"), 500)


@query("activity_recent_5_per_app", with_views("tracked") + """SELECT job_id, app_id, ts, place FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY ts DESC, job_id DESC)::INTEGER AS place FROM tracked) WHERE place <= 5""")
def activity_recent_5_per_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.latest_per_key(inputs.tracked(spark, sf_dir).select("job_id", "app_id", "ts"), "app_id", ["ts", "job_id"], 5)


# Directory

NORMALIZED = with_views("directory_rows") + r""",
n AS (SELECT seq, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email,
  regexp_replace(regexp_replace(lower(company), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS company,
  nullif(regexp_replace(full_name, '^\s+|\s+$', '', 'g'), '') AS full_name, nullif(regexp_replace(phone, '^\s+|\s+$', '', 'g'), '') AS phone, verified, domains, threshold, opt_in FROM directory_rows),
g AS (SELECT *, email IS NULL OR NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')
  OR split_part(email, '@', -1) IN ('gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'hotmail.co.il', 'live.com', 'msn.com', 'yahoo.com', 'yahoo.co.il', 'walla.co.il', 'walla.com', 'icloud.com', 'me.com', 'aol.com') OR coalesce(company, '') = '' AS bad FROM n)
"""
OUTCOMES = NORMALIZED + """, k AS (SELECT *, count(*) OVER w AS before, max(full_name) OVER w AS had_name, max(phone) OVER w AS had_phone FROM g WHERE NOT bad
  WINDOW w AS (PARTITION BY email ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
outcomes AS (SELECT seq, email, CASE WHEN before = 0 THEN 'created' WHEN (had_name IS NULL AND full_name IS NOT NULL) OR (had_phone IS NULL AND phone IS NOT NULL) THEN 'enriched' ELSE 'unchanged' END AS outcome FROM k
  UNION ALL SELECT seq, email, 'rejected' FROM g WHERE bad)
"""


@query("directory_upsert_outcomes", OUTCOMES + "SELECT * FROM outcomes")
def directory_upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.upsert_outcomes(inputs.directory_rows(spark, sf_dir))


@query("directory_import_report", OUTCOMES + """SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'enriched') AS enriched,
  count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'rejected') AS rejected FROM outcomes""")
def directory_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.import_report(directory.upsert_outcomes(inputs.directory_rows(spark, sf_dir)))


PEOPLE = NORMALIZED + """, people AS (SELECT email, arg_min(company, seq) AS company, arg_min(full_name, seq) FILTER (full_name IS NOT NULL) AS full_name,
  arg_min(phone, seq) FILTER (phone IS NOT NULL) AS phone, bool_or(verified) AS verified FROM g WHERE NOT bad GROUP BY email)
"""


@query("directory_people", PEOPLE + "SELECT * FROM people")
def directory_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.directory(inputs.directory_rows(spark, sf_dir))


@query("directory_search", PEOPLE + "SELECT company, full_name, verified FROM (SELECT * FROM people WHERE starts_with(company, 'acme 1') ORDER BY email LIMIT 10)")
def directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.public(directory.search(directory.directory(inputs.directory_rows(spark, sf_dir)), "  ACME   1"))


ROSTER = NORMALIZED + r""", parsed AS (SELECT seq, email, company,
  nullif(list_filter(list_transform(regexp_split_to_array(domains, '[;,]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), []::VARCHAR[]) AS domains,
  CASE WHEN floor(try_cast(threshold AS DOUBLE)) > 0 THEN floor(try_cast(threshold AS DOUBLE)) ELSE 75 END::INTEGER AS threshold,
  coalesce(regexp_replace(opt_in, '^\s+|\s+$', '', 'g') <> '', false) AS opted_in FROM g WHERE NOT bad),
roster AS (SELECT email, company, domains, threshold, opted_in FROM parsed QUALIFY row_number() OVER (PARTITION BY email ORDER BY seq DESC) = 1)
"""


@query("directory_roster", ROSTER + "SELECT email, company, array_to_string(domains, '|') AS domains, threshold, opted_in FROM roster")
def directory_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.roster(inputs.directory_rows(spark, sf_dir)).withColumn("domains", F.array_join("domains", "|"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 50).alias("job"), F.concat(F.lit("acme "), (F.col("o_custkey") % 45).cast("string"), F.lit(" corp")).alias("company"), (F.floor(F.col("o_totalprice")) % 101).alias("score"), F.col("o_orderdate").alias("created_at"))


REQUESTS = "requests AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, o_orderkey % 50 AS job, 'acme ' || (o_custkey % 45) || ' corp' AS company, floor(o_totalprice)::BIGINT % 101 AS score, o_orderdate AS created_at FROM orders)"


def _employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = directory.roster(inputs.directory_rows(spark, sf_dir))
    return people.select(F.substring_index("email", "@", 1).alias("employee_id"), "company", "threshold", "opted_in")


@query("directory_eligible", ROSTER + f""", {REQUESTS}, employees AS (SELECT split_part(email, '@', 1) AS employee_id, company, threshold, opted_in FROM roster),
best AS (SELECT request_id, min(employee_id) AS employee_id FROM requests JOIN employees USING (company) WHERE opted_in AND score >= 75 AND threshold <= score GROUP BY 1)
SELECT request_id, employee_id, employee_id IS NOT NULL AS available FROM requests LEFT JOIN best USING (request_id)""")
def directory_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.eligible(_requests(spark, sf_dir), _employees(spark, sf_dir))


@query("directory_without_active", f"""WITH {REQUESTS}, active AS (SELECT user_id, event_id % 50 AS job, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'accepted' ELSE 'declined' END AS status FROM events)
SELECT request_id, user_id, job FROM requests r WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.user_id = r.user_id AND a.job = r.job AND status IN ('pending', 'accepted'))""")
def directory_without_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "accepted").otherwise("declined")
    active = e.select("user_id", (F.col("event_id") % 50).alias("job"), status.alias("status"))
    return directory.without_active(_requests(spark, sf_dir).select("request_id", "user_id", "job"), active).select("request_id", "user_id", "job")


@query("directory_referral_states", f"""WITH requests AS (SELECT event_id AS request_id, ts AS created_at FROM events WHERE event_type = 'purchase'),
answers AS (SELECT event_id AS answer_id, (event_id * 7) % 10000 AS request_id, CASE WHEN event_id % 2 = 0 THEN 'accepted' ELSE 'declined' END AS answer, ts FROM events WHERE event_type IN ('view', 'click')),
f AS (SELECT request_id, arg_min(answer, (ts, answer_id)) AS answer FROM answers JOIN requests USING (request_id) WHERE ts <= created_at + INTERVAL 7 DAY AND ts <= TIMESTAMP '{NOW}' AND ts >= created_at GROUP BY 1),
s AS (SELECT request_id, coalesce(answer, CASE WHEN created_at + INTERVAL 7 DAY < TIMESTAMP '{NOW}' THEN 'expired' ELSE 'pending' END) AS status FROM requests LEFT JOIN f USING (request_id))
SELECT request_id, status, status IN ('declined', 'expired') AS refunded FROM s""")
def directory_referral_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    requests = e.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"))
    answer = F.when(F.col("event_id") % 2 == 0, "accepted").otherwise("declined")
    answers = e.where(F.col("event_type").isin("view", "click")).select(F.col("event_id").alias("answer_id"), ((F.col("event_id") * 7) % 10000).alias("request_id"), answer.alias("answer"), "ts")
    return directory.referral_states(requests, answers, F.lit(NOW).cast("timestamp_ntz"))


# Text


@query("text_urls", r"""SELECT page_id, substr(sha256(url), 1, 16) AS stable_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages""")
def text_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.stable_id(F.col("url")).alias("stable_id"), T.host(F.col("url")).alias("host"))


@query("text_languages", r"""SELECT doc_id, CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0
  AND len(regexp_extract_all(text, '[\x{0590}-\x{05FF}]'))::DOUBLE / length(regexp_replace(text, '\s', '', 'g')) > 0.2 THEN 'he' ELSE 'en' END AS language FROM documents""")
def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("text_pool_dedup", """SELECT source, text_id, doc_id FROM (SELECT source, md5(text) AS text_id, doc_id, row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def text_pool_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First write wins for each source and text."""
    docs = table(spark, sf_dir, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("text_id"), "doc_id")
    return docs.groupBy("source", "text_id").agg(F.min("doc_id").alias("doc_id"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("text_prefilter", rf"""WITH w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')), lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({_STOP})) AS words FROM benchmark),
p AS (SELECT item_id, doc_id FROM w, documents WHERE len(words) < 5 OR len(list_filter(words, lambda x: contains(lower(text), x))) >= 2),
n AS (SELECT item_id, count(*) AS passed FROM p GROUP BY 1)
SELECT item_id, coalesce(passed, 0) AS passed FROM benchmark LEFT JOIN n USING (item_id)""")
def text_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every profile text; a profile that none passes counts 0."""
    items = table(spark, sf_dir, "benchmark")
    told = prefilter.passed(items, table(spark, sf_dir, "documents"))
    return items.select("item_id").join(told, "item_id", "left").select("item_id", F.coalesce("passed", F.lit(0)).cast("long").alias("passed"))


@query("text_prefilter_all", rf"""WITH w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')), lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({_STOP})) AS words FROM benchmark),
p AS (SELECT item_id, doc_id FROM w, documents WHERE len(words) < 5 OR len(list_filter(words, lambda x: contains(lower(text), x))) >= 2)
SELECT item_id, count(*) AS passed FROM p GROUP BY 1""")
def text_prefilter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every profile text."""
    return prefilter.passed(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def _plain(column: str) -> str:
    for tag in ("script", "style", "noscript", "svg", "template", "iframe", "nav", "header", "footer", "aside"):
        column = rf"regexp_replace({column}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    column = rf"regexp_replace({column}, '(?s)<!--.*?-->', ' ', 'g')"
    column = rf"regexp_replace({column}, '(?i)<br[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article)\b[^>]*>', chr(10), 'g')"
    column = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for name, mark in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        column = f"replace({column}, '{name}', {mark})"
    column = rf"regexp_replace(regexp_replace({column}, '\r\n?', chr(10), 'g'), '[\t\x{{A0}} ]+', ' ', 'g')"
    column = rf"regexp_replace(regexp_replace({column}, ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({column}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


@query("text_signals", with_views("postings") + rf"""SELECT posting_id, len(list_filter([{", ".join("'" + x.replace("'", "''") + "'" for x in T.SIGNALS)}], lambda x: contains(lower(text), x))) > 0 AS has_signal,
  len(list_filter([{", ".join(f"'{x}'" for x in T.PAGE_WORDS[0])}], lambda x: contains(lower(text), x))) >= 2 OR len(list_filter([{", ".join(f"'{x}'" for x in T.PAGE_WORDS[1])}], lambda x: contains(lower(text), x))) >= 3 AS vacancies,
  len(regexp_extract_all(text[1:300], '[\x{{0590}}-\x{{05FF}}]')) > 15 AS hebrew FROM postings""")
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return inputs.postings(spark, sf_dir).select("posting_id", T.has_signal(text).alias("has_signal"), T.has_page_words(text).alias("vacancies"), T.begins_in_hebrew(text).alias("hebrew"))


ADDRESS = "'https://h.example' || CASE o_orderkey % 9 WHEN 0 THEN '/jobs/view/' || o_orderkey WHEN 1 THEN '/jobs/search?keywords=x' WHEN 2 THEN '/careers/' WHEN 3 THEN '/jobs?currentJobId=' || o_orderkey WHEN 4 THEN '/job/engineer' WHEN 5 THEN '/about' WHEN 6 THEN '/o/abc-def-1' WHEN 7 THEN '/search?q=spark&jk=1' ELSE '/openings' END"
KINDS = f"""WITH a AS (SELECT o_orderkey AS job_id, {ADDRESS} AS url, o_orderkey % 5 = 0 AS pane FROM orders),
f AS (SELECT *, regexp_matches(url, '{T.DETAIL_ADDRESS}') AS detail, regexp_matches(url, '{T.LIST_ADDRESS}') AS listed, regexp_matches(url, '{T.OPEN_ADDRESS}') AS opened FROM a)
SELECT job_id, CASE WHEN detail AND NOT listed THEN 'single' WHEN listed AND (pane OR opened) THEN 'hybrid' WHEN listed THEN 'listing' WHEN detail OR pane THEN 'single' ELSE 'listing' END AS kind,
  lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS url_hash FROM (SELECT *, list_reduce(list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT), lambda x, c: (x * 31 + c) % 4294967296) AS h FROM f)"""


@query("text_page_kinds", KINDS)
def text_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS job_id", f"{ADDRESS} AS url", "o_orderkey % 5 = 0 AS pane")
    return rows.select("job_id", T.page_kind(F.col("url"), F.col("pane")).alias("kind"), T.url_hash(F.col("url")).alias("url_hash"))


def _answer(column: str) -> str:
    fits = lambda pattern: f"regexp_matches({column}, {_sql(pattern)})"
    first = " ".join(f"WHEN {fits(p)} THEN {n}" for p, n in T.ANSWERS)
    points = " + ".join(f"CASE WHEN {fits(p)} THEN {n} ELSE 0 END" for p, n in T.ANSWER_POINTS)
    return f"CASE WHEN length({column}) < 3 THEN 0 {first} WHEN {fits(T.THEORY)} AND NOT {fits(T.PRACTICE)} THEN 35 ELSE greatest(0, least(100, 15 + least(20, length({column}) // 9) + {points})) END::BIGINT"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


ANSWER_TEXT = "CASE conv_id % 4 WHEN 0 THEN 'I worked with ' || text WHEN 1 THEN 'no experience with ' || text WHEN 2 THEN 'heard of ' || text ELSE text END"


@query("text_answer_scores", rf"""WITH a AS (SELECT conv_id, turn, lower(regexp_replace(coalesce({ANSWER_TEXT}, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')) AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, {_answer("t")} AS score FROM a""")
def text_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("conv_id", "turn", f"{ANSWER_TEXT} AS answer")
    return rows.select("conv_id", "turn", T.answer_score(F.col("answer")).alias("score"))


@query("text_plain_pages", f"SELECT page_id, {_plain('html')} AS text FROM pages")
def text_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


# Matcher


LINES = with_views("postings") + rf""", l AS (SELECT posting_id, unnest(generate_series(1, len(a))) - 1 AS line_no, unnest(a) AS line FROM (SELECT posting_id, string_split(text, chr(10)) AS a FROM postings)),
t AS (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l),
m AS (SELECT *, length(t) BETWEEN 1 AND 60 AS short,
  length(regexp_replace(regexp_replace(regexp_replace(t, '^[-•*·◦\s]+', ''), {_sql(matcher.ADVANTAGE_PHRASE)}, '', 'g'), '[:：().!\-–—,\s]+', '', 'g')) AS residue,
  regexp_matches(t, '[:：]\s*$') OR len(regexp_split_to_array(regexp_replace(t, '^[-•*·]\s*', ''), '\s+')) <= 4 AS shaped FROM t),
k AS (SELECT *, CASE WHEN short AND regexp_matches(t, {_sql(matcher.ADVANTAGE_HEADER)}) AND residue <= 6 THEN 'advantage'
  WHEN short AND shaped AND regexp_matches(t, {_sql(matcher.REQUIREMENT_HEADER)}) THEN 'required'
  WHEN short AND shaped AND regexp_matches(t, {_sql(matcher.CONTEXT_HEADER)}) THEN 'context' END AS mark FROM m),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY posting_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'context') AS state,
  coalesce(bool_or(mark IN ('advantage', 'required')) OVER (PARTITION BY posting_id), false) AS saw FROM k),
b AS (SELECT *, coalesce(CASE WHEN mark IS NOT NULL OR t = '' OR state = 'context' THEN NULL WHEN regexp_matches(t, {_sql(matcher.REQUIRED_SUFFIX)}) THEN 'required'
  WHEN regexp_matches(t, {_sql(matcher.ADVANTAGE_SUFFIX)}) THEN 'advantage' END, state) AS bucket0 FROM s),
lines AS (SELECT posting_id, line_no::INTEGER AS line_no, line, CASE WHEN saw OR bucket0 <> 'context' THEN bucket0 ELSE 'required' END AS bucket FROM b)
"""


@query("match_sections", LINES + "SELECT * FROM lines")
def match_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.section_lines(inputs.postings(spark, sf_dir))


def _low(column: str) -> str:
    for word, number in matcher.YEAR_WORDS:
        column = f"replace({column}, '{word}', '{number}')"
    return column


_LEXICON = ", ".join(f"({_sql(t)}, '{d}', {_sql(matcher.term_pattern(t))})" for t, d in matcher.DOMAIN_OF.items())
_GUARD = " AND ".join(f"(tech <> '{t}' OR regexp_matches(low, {_sql(g)}))" for t, g in matcher.GUARDS.items())
REQS = LINES + rf""", lex(tech, domain, pattern) AS (VALUES {_LEXICON}),
f0 AS (SELECT *, {_low("lower(line)")} AS low, line_no + CASE bucket WHEN 'required' THEN 0 ELSE 1048576 END AS place FROM lines WHERE bucket <> 'context' AND regexp_matches(line, '\S')),
facts AS (SELECT *, coalesce(nullif(regexp_extract(low, {_sql(matcher.YEAR_RANGE)}, 1), ''), nullif(regexp_extract(low, {_sql(matcher.YEARS)}, 1), ''))::DOUBLE AS years,
  regexp_matches(line, {_sql(matcher.INDUSTRY_ONLY)}) AS industry, regexp_matches(low, {_sql(matcher.ANY_OF)}) AS any_of FROM f0),
hits AS (SELECT facts.*, tech, domain FROM facts JOIN lex ON contains(low, tech) AND regexp_matches(low, pattern)),
h AS (SELECT *, min(place) FILTER ({_GUARD}) OVER (PARTITION BY posting_id, tech) AS first FROM hits),
g AS (SELECT posting_id, tech, domain, first AS place, arg_min(bucket, place) AS section, arg_min(any_of, place) AS any_of, arg_min(industry, place) AS own_industry,
  arg_min(years, place) FILTER (years IS NOT NULL) AS years, arg_min(industry, place) FILTER (years IS NOT NULL) AS filled FROM h WHERE place >= first GROUP BY ALL),
reqs AS (SELECT posting_id, tech, domain, section, place::INTEGER AS place, years, own_industry OR coalesce(filled, false) AS industry,
  (CASE WHEN any_of AND count(*) OVER (PARTITION BY posting_id, place) >= 2 THEN place END)::INTEGER AS grp FROM g)
"""


@query("match_requirements", REQS + "SELECT * FROM reqs")
def match_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matcher.requirements(matcher.line_facts(matcher.told_lines(inputs.postings(spark, sf_dir))))


def _curve(r: str) -> str:
    return f"(CASE WHEN {r} >= 1 THEN 1 WHEN {r} <= 0 THEN 0 ELSE 1 - pow(1 - {r}, 1.5) END)::DOUBLE"


_CATEGORY = ", ".join(f"('{d}', {_sql(w)}, {'NULL' if d == 'fullstack' or not w[0].isascii() else _sql(matcher.term_pattern(w))})" for d, words in matcher.CATEGORIES.items() for w in words)
_ROLE = ", ".join(f"('{d}', {_sql(w)})" for d, words in matcher.ROLES.items() for w in words)
_TOTAL = ", ".join(f"nullif(regexp_extract(low, {_sql(p)}, 1), '')" for p in matcher.TOTAL_YEARS)
_SECOND = " ".join(f"WHEN '{t}' THEN '{d}'" for t, d in matcher.SECOND_DOMAIN.items())
SCORES = REQS + rf""", cat(domain, word, pattern) AS (VALUES {_CATEGORY}), role(domain, word) AS (VALUES {_ROLE}),
asked AS (SELECT DISTINCT f.posting_id, c.domain, f.place, f.bucket = 'required' AS required, f.years FROM facts f JOIN cat c ON CASE WHEN pattern IS NULL THEN contains(low, word) ELSE regexp_matches(low, pattern) END
  WHERE (f.years IS NOT NULL OR regexp_matches(line, {_sql(matcher.CATEGORY_CONTEXT)})) AND NOT EXISTS (SELECT 1 FROM reqs r WHERE r.posting_id = f.posting_id AND r.place = f.place AND r.domain = c.domain)),
cats AS (SELECT posting_id, domain, arg_min(required, place) AS required, arg_min(years, place) FILTER (years IS NOT NULL) AS years FROM asked GROUP BY posting_id, domain),
carried AS (SELECT DISTINCT posting_id, domain FROM reqs WHERE section = 'required'),
used AS (SELECT h.posting_id, h.place FROM hits h JOIN reqs r ON r.posting_id = h.posting_id AND r.tech = h.tech AND h.place >= r.place UNION SELECT posting_id, place FROM asked),
totals AS (SELECT posting_id, arg_min(total, place) AS total FROM (SELECT posting_id, place, coalesce({_TOTAL})::DOUBLE AS total FROM facts) t WHERE total IS NOT NULL AND NOT EXISTS (SELECT 1 FROM used u WHERE u.posting_id = t.posting_id AND u.place = t.place) GROUP BY 1),
solid AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY line_no) AS nth FROM lines WHERE regexp_matches(line, '\S')),
roles AS (SELECT DISTINCT posting_id, domain FROM solid JOIN role ON contains(lower(line), word) WHERE nth <= 2 OR (bucket = 'required' AND regexp_matches(line, {_sql(matcher.ROLE_CONTEXT)}))),
members AS (SELECT posting_id, CASE WHEN section = 'required' AND grp IS NOT NULL THEN 'group ' || grp ELSE 'term ' || tech END AS gid, 'term' AS kind, tech, domain, section = 'required' AS required, years, industry FROM reqs
  UNION ALL SELECT posting_id, 'category ' || domain, 'category', NULL, domain, required, years, false FROM cats WHERE coalesce(years, 0) > 0 OR (posting_id, domain) NOT IN (SELECT (posting_id, domain) FROM carried)
  UNION ALL SELECT posting_id, 'role ' || domain, 'role', NULL, domain, true, NULL, false FROM (FROM roles EXCEPT FROM carried EXCEPT SELECT posting_id, domain FROM cats)
  UNION ALL SELECT posting_id, 'total', 'total', NULL, NULL, true, total, false FROM totals WHERE total > 0),
weights AS (SELECT posting_id, gid, (CASE any_value(kind) WHEN 'role' THEN 8 WHEN 'total' THEN 15 ELSE CASE WHEN bool_or(coalesce(years, 0) > 0) THEN 10 WHEN any_value(kind) = 'term' THEN 12 ELSE 8 END END)::DOUBLE * CASE WHEN bool_and(required) THEN 1 ELSE 0.4::DOUBLE END AS w FROM members GROUP BY posting_id, gid),
entries AS (SELECT *, industry + personal * (greatest(0, least(100, coalesce(weight, CASE WHEN domain = 'ai_ml_llm' THEN 75 ELSE 50 END))) / 100.0::DOUBLE) AS eff FROM (
  SELECT profile_id, domain, tech, tag, ((profile_id + j) % 6 * 0.5)::DOUBLE AS industry, (j % 4)::DOUBLE AS personal, CASE WHEN j % 2 = 0 THEN j * 20 END AS weight
  FROM (SELECT n_nationkey::BIGINT AS profile_id, j, {inputs.pick("n_nationkey * 3 + j * 4")} AS tech, {inputs.pick("n_nationkey + j")} AS tag FROM nation, generate_series(0, 5) s(j)) JOIN lex USING (tech))),
skills AS (SELECT profile_id, term, eff, ind FROM (SELECT profile_id, tech AS term, 1 AS own, eff, industry AS ind FROM entries UNION ALL SELECT profile_id, tag, 0, eff, industry FROM entries)
  QUALIFY row_number() OVER (PARTITION BY profile_id, term ORDER BY own DESC, eff DESC, ind DESC) = 1),
doms AS (SELECT profile_id, domain, max(eff) AS eff FROM entries GROUP BY 1, 2),
people AS (SELECT n_nationkey::BIGINT AS profile_id, (n_nationkey % 9)::DOUBLE AS mine FROM nation),
m0 AS (SELECT people.profile_id, mine, x.*, coalesce(s.eff, 0) AS eff, coalesce(s.ind, 0) AS ind, coalesce(d.eff, 0) AS around, coalesce(e.eff, 0) AS second, coalesce(years, 0) > 0 AS asks, CASE WHEN coalesce(years, 0) > 0 THEN years ELSE 1 END AS need
  FROM people CROSS JOIN members x LEFT JOIN skills s ON s.profile_id = people.profile_id AND s.term = x.tech LEFT JOIN doms d ON d.profile_id = people.profile_id AND d.domain = x.domain
  LEFT JOIN doms e ON e.profile_id = people.profile_id AND e.domain = CASE x.tech {_SECOND} END),
m1 AS (SELECT *, CASE WHEN required AND industry THEN ind ELSE eff END AS held, least(1, CASE WHEN required AND industry THEN ind ELSE eff END / need) AS part FROM m0),
rated AS (SELECT *, CASE kind WHEN 'term' THEN CASE WHEN held > 0 THEN CASE WHEN required AND NOT asks AND NOT industry AND eff >= 0.5 THEN greatest(0.7::DOUBLE, {_curve("part")}) WHEN NOT required AND NOT asks THEN 1 ELSE {_curve("part")} END ELSE 0.35::DOUBLE * least(1, greatest(around, second) / need) END
  WHEN 'category' THEN {_curve("least(1, around / need)")} WHEN 'role' THEN (around > 0)::INTEGER ELSE CASE WHEN mine > 0 THEN {_curve("mine / years")} ELSE 0.35::DOUBLE END END AS ratio FROM m1),
best AS (SELECT profile_id, posting_id, gid, coalesce(max(ratio) FILTER (held > 0), max(ratio)) AS ratio FROM rated GROUP BY 1, 2, 3),
sums AS (SELECT profile_id, posting_id, sum(ratio * w) AS earned, sum(w) AS weight FROM best JOIN weights USING (posting_id, gid) GROUP BY 1, 2),
terms AS (SELECT profile_id, posting_id, array_to_string(list_sort(list(tech) FILTER (ratio >= 0.5)), '|') AS matched, array_to_string(list_sort(list(tech) FILTER (ratio < 0.5)), '|') AS missing FROM rated WHERE tech IS NOT NULL GROUP BY 1, 2),
scores AS (SELECT profile_id, posting_id, greatest(18, least(94, CASE WHEN t.posting_id IS NULL THEN least(40, round(round(coalesce(earned / weight, 0.25), 9) * 100)) ELSE round(round(earned / weight, 9) * 100) END))::BIGINT AS score,
  coalesce(matched, '') AS matched, coalesce(missing, '') AS missing FROM people CROSS JOIN postings LEFT JOIN sums USING (profile_id, posting_id) LEFT JOIN terms t USING (profile_id, posting_id))
"""


def _listed(scored: DataFrame) -> DataFrame:
    return scored.withColumns({c: F.array_join(c, "|") for c in ("matched", "missing")})


@query("match_scores", SCORES + "SELECT * FROM scores")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile against every posting; terms are joined by bars."""
    people = matcher.profiles(*inputs.profile_tables(spark, sf_dir))
    return matcher.once_a_text(inputs.postings(spark, sf_dir), lambda texts: _listed(matcher.scores(matcher.parsed(texts), people)))


@query("match_top_postings", SCORES + "SELECT *, (row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, posting_id))::INTEGER AS place FROM scores WHERE score >= 40 QUALIFY place <= 12")
def match_top_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(matcher.top_postings(inputs.postings(spark, sf_dir), matcher.profiles(*inputs.profile_tables(spark, sf_dir)), 12, least=40))


# Documents with marked sections


@query("cv_sections", with_views("cvs") + r""", l AS (SELECT doc_id, unnest(generate_series(1, len(a))) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM cvs)),
m AS (SELECT *, nullif(regexp_extract(trim(line), '^\[([A-Z ]+)\]$', 1), '') AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'PROFILE') AS section FROM m)
SELECT doc_id, line_no::INTEGER AS line_no, section, line FROM s WHERE mark IS NULL AND trim(line) <> ''""")
def cv_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_cv.section_lines(inputs.cvs(spark, sf_dir))


UNITS = rf"""WITH e AS (SELECT * FROM ({SQL["cv_sections"]}) WHERE section = 'EXPERIENCE'),
k AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*[-•*·▪‣–]\s+') THEN 'bullet' WHEN regexp_matches(trim(line), ' \| |\b(19|20)\d{{2}}\b') THEN 'header' ELSE 'free' END AS kind FROM e),
b AS (SELECT *, kind = 'header' OR (kind = 'free' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) = 'bullet', true)) AS starts FROM k),
u AS (SELECT *, sum((starts OR kind = 'bullet')::INTEGER) OVER w AS unit, sum(starts::INTEGER) OVER w - 1 AS role FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
v AS (SELECT *, role + coalesce(bool_and(kind = 'bullet') FILTER (unit = 1) OVER (PARTITION BY doc_id), false)::INTEGER AS role_index FROM u)
SELECT doc_id, min(line_no) AS line_no, CASE WHEN bool_or(kind = 'bullet') THEN 'bullet' ELSE 'role' END AS kind, max(role_index)::BIGINT AS role_index,
  string_agg(trim(regexp_replace(line, '^\s*[-•*·▪‣–]\s+', '')), ' ' ORDER BY line_no) AS text FROM v GROUP BY doc_id, unit"""


@query("cv_units", UNITS)
def cv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_cv.units(cv_sections(spark, sf_dir).where("section = 'EXPERIENCE'"))


@query("cv_page_fit", r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, ' \| |\b(19|20)\d{2}\b') AND NOT regexp_matches(x, '^\s*[-•*·▪‣–]\s+'))) AS roles FROM documents)
SELECT doc_id, words, roles, round_even((words + roles * 2) / 620.0::DOUBLE - 1, 3) AS ratio, (words + roles * 2) / 620.0::DOUBLE - 1 > 0.15 AS overflows FROM w""")
def cv_page_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_cv.page_fit(table(spark, sf_dir, "documents").where("text is not null"))


@query("cv_revisions")
def cv_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generated document against the one before it."""
    now = cv_units(spark, sf_dir)
    old = now.select((F.col("doc_id") + 1).alias("doc_id"), "line_no", "text")
    return documents_cv.revisions(now.select("doc_id", "line_no", "text"), old)


@query("cv_line_diffs")
def cv_line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.cvs(spark, sf_dir)
    pairs = docs.select("doc_id", F.col("text").alias("new")).join(docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old")), "doc_id")
    return documents_cv.line_diffs(pairs)


BLOCKS = "blocks AS (SELECT l_orderkey AS doc_id, l_linenumber AS block, (l_linenumber * 3 + l_partkey % 2)::BIGINT AS first, (l_linenumber * 3 + l_suppkey % 7)::BIGINT AS last FROM lineitem)"


@query("cv_clamped_blocks", f"""WITH {BLOCKS} SELECT doc_id, block, first, greatest(first, least(last, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first, block, last) - 1, last))) AS last FROM blocks""")
def cv_clamped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS block", "l_linenumber * 3 + l_partkey % 2 AS first", "l_linenumber * 3 + l_suppkey % 7 AS last")
    return documents_cv.clamped_blocks(rows.withColumns({"first": F.col("first").cast("long"), "last": F.col("last").cast("long")}))


@query("cv_rescaled_weights", """WITH r AS (SELECT l_orderkey AS group_id, l_partkey * 10 + l_linenumber AS seq, l_quantity AS weight FROM lineitem),
s AS (SELECT group_id, seq, weight, round_even(weight * 20 / sum(weight) OVER (PARTITION BY group_id), 0)::BIGINT AS share FROM r),
t AS (SELECT *, 20 - sum(share) OVER (PARTITION BY group_id ORDER BY seq, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rest, lead(seq) OVER (PARTITION BY group_id ORDER BY seq, weight) IS NULL AS is_last FROM s)
SELECT group_id, seq, (CASE WHEN is_last THEN coalesce(rest, 20) ELSE share END)::BIGINT AS weight FROM t""")
def cv_rescaled_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("weight"))
    return documents_cv.rescaled_weights(rows, 20)


# Pool


@query("pool_since", f"""SELECT id, user_id, scraped_at FROM (SELECT event_id AS id, user_id, ts AS scraped_at FROM events) WHERE scraped_at >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY ORDER BY scraped_at DESC, id DESC LIMIT 2000""")
def pool_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("scraped_at"))
    return readers.pool_since(pool, readers.lookback(F.lit(NOW).cast("timestamp_ntz"), 20))


@query("pool_contribution", """WITH b AS (SELECT doc_id AS seq, CASE WHEN doc_id % 9 = 0 THEN 'ftp://x' ELSE 'http://h/' || (doc_id % 700) END AS url, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE source END AS text FROM documents),
p AS (SELECT 'http://h/' || page_id AS url FROM pages),
u AS (SELECT *, regexp_matches(url, '^https?://') AND trim(coalesce(text, '')) <> '' AS usable FROM b),
c AS (SELECT *, min(seq) FILTER (usable) OVER (PARTITION BY url) AS first, url IN (SELECT url FROM p) AS held FROM u)
SELECT CASE WHEN NOT usable THEN 'skipped' WHEN held OR seq <> first THEN 'duplicate' ELSE 'saved' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def pool_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    batch = table(spark, sf_dir, "documents").select(k.alias("seq"), F.when(k % 9 == 0, "ftp://x").otherwise(F.concat(F.lit("http://h/"), (k % 700).cast("string"))).alias("url"), F.when(k % 11 == 0, " ").otherwise(F.col("source")).alias("text"))
    pool = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://h/"), F.col("page_id").cast("string")).alias("url"))
    return writers.classified(batch, pool).groupBy("outcome").agg(F.count("*").alias("n"))


# State


@query("state_rate_limit", "WITH RECURSIVE o AS (SELECT event_id AS call_id, user_id AS key, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL)" + """,
f AS (SELECT call_id, key, rn, true AS allowed, [sec] AS hits FROM o WHERE rn = 1
  UNION ALL
  SELECT o.call_id, o.key, o.rn, len(list_filter(hits, lambda h: h > sec - 86400)) < 2,
    CASE WHEN len(list_filter(hits, lambda h: h > sec - 86400)) < 2 THEN list_append(list_filter(hits, lambda h: h > sec - 86400), sec) ELSE list_filter(hits, lambda h: h > sec - 86400) END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
SELECT call_id, key, allowed FROM f""")
def state_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.col("user_id").alias("key"), "ts")
    return stateful.rate_limited(calls, 2, 86400)


@query("state_cache", """WITH e AS (SELECT user_id AS key, ts, event_type = 'view' AS valid FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT event_id AS read_id, user_id AS key, ts FROM events WHERE event_type = 'purchase')
SELECT read_id, coalesce((SELECT arg_max(r.ts < e.ts + CASE WHEN valid THEN INTERVAL 3600 SECOND ELSE INTERVAL 30 SECOND END, e.ts) FROM e WHERE e.key = r.key AND e.ts <= r.ts), false) AS hit FROM r""")
def state_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entries = e.where(F.col("event_type").isin("view", "click")).select(F.col("user_id").alias("key"), "ts", (F.col("event_type") == "view").alias("valid"))
    return stateful.cache_states(entries, e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("read_id")))


@query("state_clicks_per_window", with_views("clicks") + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, target, count(*) AS n FROM clicks GROUP BY ALL")
def state_clicks_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.clicks_per_window(inputs.clicks(spark, sf_dir))
