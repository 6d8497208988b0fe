"""Registered queries over rewritten documents, tracked links and journeys. Their SQL states its constants itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import links
from matchweave.operators import directory, journeys, rewriting
from matchweave.plans import inputs
from matchweave.plans.inputs import table, with_views
from matchweave.plans.registry import query

#: The returned text of a block, the same for every engine.
RETURNED = "CASE doc_id % 5 WHEN 0 THEN left(text, (length(text) * 0.9)::INTEGER) WHEN 1 THEN left(text, (length(text) * 0.97)::INTEGER) WHEN 2 THEN left(text, (length(text) * 0.5)::INTEGER) WHEN 3 THEN '' ELSE text || ' more' END"
SPARK_RETURNED = RETURNED.replace("(length(text) * ", "CAST(floor(length(text) * ").replace(")::INTEGER)", ") AS INTEGER))")
RETURNED = RETURNED.replace("(length(text) * ", "floor(length(text) * ")


@query("cv_block_verdicts", f"""WITH b AS (SELECT doc_id, length(coalesce(text, '')) AS n, doc_id % 3 = 0 AS focus, doc_id % 3 <> 0 AND doc_id % 4 <> 1 AS shrink, {RETURNED} AS made FROM documents)
SELECT doc_id, 0 AS block, CASE WHEN coalesce(length(made), 0) = 0 OR NOT (focus OR shrink) THEN 'not_requested' WHEN shrink AND length(made) >= n * 0.95::DOUBLE THEN 'shrink_not_shorter'
  WHEN focus AND length(made) < n * 0.6::DOUBLE THEN 'expand_got_shorter' ELSE 'kept' END AS verdict FROM b""")
def cv_block_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    blocks = docs.select("doc_id", F.lit(0).alias("block"), "text", (k % 3 == 0).alias("focus"), (k % 4 != 1).alias("shrink"))
    return rewriting.block_verdicts(blocks, docs.selectExpr("doc_id", "0 AS block", f"{SPARK_RETURNED} AS text"))


UPDATED = "CASE doc_id % 6 WHEN 0 THEN text || ' **x**' WHEN 1 THEN text || ' 7' WHEN 2 THEN left(text, 3) ELSE text || '!' END"


@query("cv_change_reasons", rf"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(text, '') END AS old, coalesce({UPDATED}, '') AS new FROM documents)
SELECT doc_id, CASE WHEN old = '' THEN 'new' WHEN len(regexp_extract_all(new, '\*\*')) > len(regexp_extract_all(old, '\*\*')) THEN 'emphasised' WHEN regexp_matches(new, '[0-9]') AND NOT regexp_matches(old, '[0-9]') THEN 'measured'
  WHEN length(new) < length(old) * 0.8::DOUBLE THEN 'shortened' ELSE 'adapted' END AS reason FROM p""")
def cv_change_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS old", f"{UPDATED} AS new")
    return pairs.select("doc_id", rewriting.change_reason(F.col("old"), F.col("new")).alias("reason"))


SAID = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'Main Strengths:' WHEN 3 THEN 'What is missing' WHEN 5 THEN 'In summary' ELSE coalesce(text, '') END"


@query("cv_analysis_modes", rf"""WITH l AS (SELECT conv_id AS doc_id, turn AS line_no, {SAID} AS line FROM conversations),
m AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)חוזק|strength|יתרון|חיובי') THEN 'strength' WHEN regexp_matches(line, '(?i)פער|חסר|gap|weakness|לשפר|missing|בעי') THEN 'gap' WHEN regexp_matches(line, '(?i)המלצ|לסיכום|conclusion|summary') THEN 'neutral' END AS mark FROM l)
SELECT doc_id, line_no, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'neutral') AS mode FROM m""")
def cv_analysis_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS line_no", f"{SAID} AS line")
    return rewriting.analysis_modes(lines)


#: Thirty lines before the heading of every other posting.
LONG = f"repeat('intro' || chr(10), CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN 3 ELSE 0 END) || CASE WHEN p_partkey % 4 = 0 THEN '  What you' || chr(39) || 'll do' || chr(10) ELSE '' END || {inputs.POSTING_TEXT}"


@query("text_descriptions", rf"""WITH a AS (SELECT p_partkey AS posting_id, string_split({LONG}, chr(10)) AS l FROM part),
f AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^\s*(?:(?:requirements?|qualifications?|responsibilities|about the (?:role|job)|the role|what you''?ll (?:do|need)|we(?:''| a)re looking for|must have|nice to have)(?:[^a-z0-9_]|$)|(?:דרישות(?: התפקיד)?|תיאור התפקיד|מה נדרש|על התפקיד)[a-z0-9_])')), true) AS pos FROM a)
SELECT posting_id, array_to_string(l[greatest(0, coalesce(pos, 1) - 1 - 25) + 1:], chr(10)) AS text FROM f""")
def text_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS posting_id", f"{LONG} AS text")
    return rows.select("posting_id", rewriting.description(F.col("text")).alias("text"))


PAGED = "'[NAME]' || chr(10) || doc_id || chr(10) || '[CONTACT]' || chr(10) || 'a' || chr(10) || 'b' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'c' ELSE '' END || chr(10) || '[PROFILE]' || chr(10) || coalesce(text, '') || chr(10) || '[EXPERIENCE]' || repeat(chr(10) || '- built and ran ' || coalesce(source, '') || ' systems for a number of large teams across several regions and sites', (doc_id % 30)::INTEGER) || chr(10) || '[SKILLS]' || chr(10) || 'sql'"
SPARK_PAGED = PAGED.replace("(doc_id % 30)::INTEGER", "CAST(doc_id % 30 AS INT)")
_ROOM = (("normal", 99, 58), ("tight", 106, 62), ("compact", 113, 66))
_COUNTS = ", ".join(rf"sum(CASE WHEN section IN ('PROFILE', 'EXPERIENCE', 'EDUCATION', 'SKILLS', 'LANGUAGES') THEN ceil(length(t) / (CASE WHEN bullet THEN {wide - 4} ELSE {wide} END)::DOUBLE) ELSE 0 END) AS {name}" for name, wide, _ in _ROOM)
_AROUND = " + ".join(f"max((section = '{s}')::INTEGER)" for s in ("PROFILE", "EXPERIENCE", "EDUCATION", "SKILLS", "LANGUAGES", "NAME", "HEADLINE"))


@query("cv_page_tiers", rf"""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array({PAGED}, '\r?\n') AS a FROM documents)),
m AS (SELECT *, regexp_replace(line, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') AS t, nullif(regexp_extract(t, '^\[([A-Z ]+)\]$', 1), '') AS mark FROM l),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'PROFILE') AS section FROM m),
b AS (SELECT *, section IN ('EXPERIENCE', 'EDUCATION') AND NOT starts_with(t, '**') AND regexp_matches(t, '^(\$ |\* |[•\-–—]\s)') AS bullet FROM s WHERE mark IS NULL AND t <> ''),
c AS (SELECT doc_id, {_COUNTS}, {_AROUND} + least(2, ceil(count(*) FILTER (section = 'CONTACT') / 2.0)) + 1 AS around FROM b GROUP BY doc_id)
SELECT doc_id, CASE WHEN normal + around <= 58 THEN 'normal' WHEN tight + around <= 62 THEN 'tight' ELSE 'compact' END AS tier,
  (around + CASE WHEN normal + around <= 58 THEN normal WHEN tight + around <= 62 THEN tight ELSE compact END)::BIGINT AS lines,
  (CASE WHEN normal + around <= 58 THEN 58 WHEN tight + around <= 62 THEN 62 ELSE 66 END)::BIGINT AS most_lines FROM c""")
def cv_page_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewriting.page_tiers(table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPARK_PAGED} AS text"))


@query("cv_answered_scores", """WITH q AS (SELECT l_orderkey AS set_id, l_linenumber * 2 AS weight, CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 101 END AS pct FROM lineitem WHERE l_orderkey % 5 > 0),
s AS (SELECT set_id, sum(coalesce(pct, 0) * weight) AS points, sum(weight) AS total FROM q GROUP BY 1)
SELECT o_orderkey AS set_id, least(100, (o_orderkey % 90 * 100 + coalesce(points, 0) + 50) // 100)::BIGINT AS score, least(40, greatest(10, coalesce(total, 20)))::BIGINT AS gap_pct,
  CASE WHEN coalesce(total, 20) >= 20 THEN 4 ELSE 3 END::BIGINT AS n_questions FROM orders LEFT JOIN s ON set_id = o_orderkey""")
def cv_answered_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("set_id"), (F.col("o_orderkey") % 90).alias("base"))
    questions = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 > 0").selectExpr("l_orderkey AS set_id", "l_linenumber * 2 AS weight", "CASE WHEN l_partkey % 7 > 0 THEN l_partkey % 101 END AS pct")
    return rewriting.answered_scores(sets, questions)


LINKED = "'See [LINK:me|https://github.com/u' || page_id || '.], [LINK:|linkedin.com/in/u] and [my site](http://h' || page_id || '.io/a b~c*?x=1&y=é) or ' || url || ', also linkedin.com/in/u/, dev-x.io/p; mail x@foo.com/path (https://www.linkedin.com/in/u' || page_id || '/)!'"


def _made(url: str, shown: str) -> str:
    url, shown = (f"regexp_replace({x}, '[.,;:!?]+$', '')" for x in (url, shown))
    full = f"CASE WHEN starts_with({url}, 'http') THEN {url} ELSE 'https://' || {url} END"
    return f"('[LINK:' || {shown} || '|https://api.example/track?app_id=' || page_id || '&target=' || CASE WHEN contains({full}, 'github.com') THEN 'github' WHEN contains({full}, 'linkedin.com') THEN 'linkedin' ELSE 'portfolio' END || '&url=' || url_encode({full}) || ']')"


_HALF = "string_split({0}, chr(3))"
_LOOSE = rf"""regexp_replace(s, '\[([^\]]+)\]\((https?://[^)]+)\)|(https?://[^\s)\]"''>]+)|(^|[^/\w@.])([a-zA-Z0-9][a-zA-Z0-9-]{{2,}}\.(?:com|io|dev|me|net|org|co|ai|app|tech)/[^\s)\]"''>]+)', '\4' || chr(2) || '\1' || chr(3) || '\2\3\5' || chr(2), 'g')"""
_SHOWN = "CASE WHEN string_split(t, chr(3))[1] = '' THEN rtrim(regexp_replace(string_split(t, chr(3))[2], '^https?://', ''), '/') ELSE string_split(t, chr(3))[1] END"
_REST = f"array_to_string(list_transform(string_split({_LOOSE}, chr(2)), lambda t, j: CASE WHEN j % 2 = 1 THEN t ELSE {_made('string_split(t, chr(3))[2]', _SHOWN)} END), '')"
_MARKED = _made("string_split(s, chr(3))[2]", "coalesce(nullif(string_split(s, chr(3))[1], ''), string_split(s, chr(3))[2])")


@query("text_tracked_links", rf"""WITH p AS (SELECT page_id, regexp_replace({LINKED}, '\[LINK:([^|]*)\|([^\]]+)\]', chr(1) || '\1' || chr(3) || '\2' || chr(1), 'g') AS text FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(text, chr(1)), lambda s, i: CASE WHEN i % 2 = 1 THEN {_REST} ELSE {_MARKED} END), '') AS text FROM p""")
def text_tracked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{LINKED} AS text")
    return rows.select("page_id", links.tracked(F.col("text"), F.col("page_id"), "https://api.example/track").alias("text"))


KIND = "CASE event_type WHEN 'signup' THEN 'credit' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'accept' ELSE 'decline' END ELSE 'request' END"
JOB = "CASE WHEN event_id % 11 > 0 THEN event_id * 7 % 5 END"


@query("ledger_referrals", f"""WITH RECURSIVE o AS (SELECT event_id AS entry_id, user_id, ts, {KIND} AS kind, {JOB} AS job, event_id % 7 > 0 AS found, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT 0::BIGINT AS entry_id, user_id, 0::BIGINT AS rn, 0::BIGINT AS balance, []::STRUCT(job BIGINT, ts TIMESTAMP)[] AS pend, []::BIGINT[] AS done, '' AS outcome FROM o WHERE rn = 1
  UNION ALL
  SELECT entry_id, user_id, rn, bal + CASE outcome WHEN 'credited' THEN 10 WHEN 'pending' THEN -5 WHEN 'declined' THEN 5 ELSE 0 END,
    CASE WHEN outcome = 'pending' THEN list_append(live, {{'job': job, 'ts': ts}}) WHEN outcome IN ('accepted', 'declined') THEN list_filter(live, lambda p: p.job <> job) ELSE live END,
    CASE outcome WHEN 'accepted' THEN list_append(done, job) ELSE done END, outcome
  FROM (SELECT *, CASE kind WHEN 'credit' THEN 'credited' WHEN 'request' THEN CASE WHEN job IS NULL THEN 'no_job' WHEN NOT found THEN 'nobody' WHEN held OR list_contains(done, job) THEN 'active' WHEN bal < 5 THEN 'short' ELSE 'pending' END
      ELSE CASE WHEN NOT held THEN 'handled' WHEN kind = 'accept' THEN 'accepted' ELSE 'declined' END END AS outcome
    FROM (SELECT *, balance + 5 * (len(pend) - len(live)) AS bal, len(list_filter(live, lambda p: p.job = job)) > 0 AS held
      FROM (SELECT o.*, f.balance, f.done, f.pend, list_filter(f.pend, lambda p: p.ts + INTERVAL 7 DAY >= o.ts) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1))))
SELECT entry_id, user_id, outcome, balance FROM f WHERE rn > 0""")
def ledger_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS entry_id", "user_id", "ts", f"{KIND} AS kind", "10 AS credit", f"{JOB} AS job", "event_id % 7 > 0 AS found")
    return journeys.referrals(rows)


@query("state_answer_bank", """WITH RECURSIVE o AS (SELECT event_id AS entry_id, user_id, 's' || (event_id * 7 % 6) AS skill, event_id % 6 > 1 AS usable, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT 0::BIGINT AS entry_id, user_id, 0::BIGINT AS rn, []::VARCHAR[] AS bank, '' AS outcome, NULL::VARCHAR AS dropped FROM o WHERE rn = 1
  UNION ALL
  SELECT o.entry_id, o.user_id, o.rn, CASE WHEN usable AND NOT list_contains(bank, skill) THEN list_prepend(skill, bank)[1:4] ELSE bank END,
    CASE WHEN NOT usable THEN 'skipped' WHEN list_contains(bank, skill) THEN 'updated' ELSE 'added' END, CASE WHEN usable AND NOT list_contains(bank, skill) THEN bank[4] END
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT entry_id, user_id, outcome, dropped FROM f WHERE rn > 0""")
def state_answer_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = "CASE event_id % 6 WHEN 0 THEN ' לא ענה ' WHEN 1 THEN ' abc ' ELSE 'did it' END AS answer"
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS entry_id", "user_id", "ts", "CASE WHEN event_id % 2 = 0 THEN 'S' ELSE 's' END || (event_id * 7 % 6) AS skill", answer)
    return journeys.banked_answers(rows, 4)


@query("directory_import_errors", with_views("directory_rows") + r""", n AS (SELECT seq, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email, trim(company, ' ' || chr(9)) AS company FROM directory_rows)
SELECT seq, CASE WHEN email IS NULL OR NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'bad_email'
  WHEN split_part(email, '@', -1) IN ('gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'hotmail.co.il', 'live.com', 'msn.com', 'yahoo.com', 'yahoo.co.il', 'walla.co.il', 'walla.com', 'icloud.com', 'me.com', 'aol.com') THEN 'webmail'
  ELSE 'no_company' END AS reason FROM n WHERE email IS NULL OR NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR company = ''
  OR split_part(email, '@', -1) IN ('gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'hotmail.co.il', 'live.com', 'msn.com', 'yahoo.com', 'yahoo.co.il', 'walla.co.il', 'walla.com', 'icloud.com', 'me.com', 'aol.com')""")
def directory_import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.import_errors(inputs.directory_rows(spark, sf_dir))


VISIT = "CASE WHEN event_type IN ('signup', 'click') THEN 'save' ELSE 'load' END"


@query("state_recent_lists", f"""WITH RECURSIVE o AS (SELECT event_id AS entry_id, user_id, ts, {VISIT} AS kind, 'u' || (event_id % 7) AS url, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
f AS (SELECT 0::BIGINT AS entry_id, user_id, 0::BIGINT AS rn, []::STRUCT(url VARCHAR, ts TIMESTAMP)[] AS held, '' AS outcome, NULL::VARCHAR AS dropped FROM o WHERE rn = 1
  UNION ALL
  SELECT entry_id, user_id, rn, CASE outcome WHEN 'saved' THEN list_prepend({{'url': url, 'ts': ts}}, others)[1:5] WHEN 'stale' THEN others ELSE held END, outcome, CASE WHEN outcome = 'saved' THEN others[5].url END
  FROM (SELECT *, CASE WHEN kind = 'save' THEN 'saved' WHEN len(same) = 0 THEN 'miss' WHEN ts - same[1].ts > INTERVAL 240 HOUR THEN 'stale' ELSE 'hit' END AS outcome
    FROM (SELECT o.*, held, list_filter(held, lambda p: p.url = o.url) AS same, list_filter(held, lambda p: p.url <> o.url) AS others FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)))
SELECT entry_id, user_id, outcome, dropped FROM f WHERE rn > 0""")
def state_recent_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS entry_id", "user_id", "ts", f"{VISIT} AS kind", "'u' || (event_id % 7) AS url")
    return journeys.recent_lists(rows, 5, 240)
