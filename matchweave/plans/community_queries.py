"""Queries of the community's employees and their small text forms, with SQL of their own constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators import community
from matchweave.plans import inputs
from matchweave.plans.inputs import table, with_views
from matchweave.plans.registry import query

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_STATUS = "CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'declined' END"
_SOURCE = "CASE c_custkey % 3 WHEN 0 THEN 'sheet' WHEN 1 THEN 'community' ELSE 'self' END"
_REFERRAL = "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'declined' ELSE 'pending' END"
_ROWS = with_views("directory_rows") + f""", n AS (SELECT seq, {_TRIM.format("coalesce(full_name, '')")} AS full_name, {_TRIM.format("coalesce(company, '')")} AS company, lower({_TRIM.format("coalesce(email, '')")}) AS email,
  list_filter(list_transform(string_split_regex(domains, '[;,]'), lambda x: {_TRIM.format("x")}), lambda x: x <> '') AS d, CASE WHEN trunc(try_cast(threshold AS DOUBLE))::INTEGER > 0 THEN trunc(try_cast(threshold AS DOUBLE))::INTEGER ELSE 75 END AS threshold FROM directory_rows),
r AS (SELECT * REPLACE (CASE WHEN len(d) > 0 THEN d END AS d), CASE WHEN full_name = '' OR company = '' THEN 'no_name' WHEN NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'bad_email' END AS bad FROM n)
"""


@query("community_employee_outcomes", _ROWS + """SELECT seq, email, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN d IS NOT NULL AND count(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 THEN 'enriched' ELSE 'duplicate' END AS outcome
FROM r WHERE bad IS NULL WINDOW w AS (PARTITION BY email ORDER BY seq) UNION ALL SELECT seq, email, bad FROM r WHERE bad IS NOT NULL""")
def community_employee_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.employee_outcomes(inputs.directory_rows(spark, sf_dir))


@query("community_employees", _ROWS + """SELECT email, arg_min(full_name, seq) AS full_name, arg_min(company, seq) AS company, lower(regexp_replace(arg_min(company, seq), '\\s+', ' ', 'g')) AS company_key,
arg_min(threshold, seq) AS threshold, array_to_string(arg_min(d, seq) FILTER (d IS NOT NULL), '|') AS domains FROM r WHERE bad IS NULL GROUP BY email""")
def community_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.employees(inputs.directory_rows(spark, sf_dir)).withColumn("domains", F.array_join("domains", "|"))


@query("community_optins", """WITH e AS (SELECT event_id, user_id AS employee_id, ts, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'accept' WHEN 'purchase' THEN 'decline' ELSE 'self' END AS kind FROM events
  WHERE user_id IS NOT NULL AND (event_type IN ('view', 'click', 'purchase') OR (event_type = 'signup' AND event_id % 7 = 0))),
o AS (SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY ts, event_id) AS rn FROM e),
f AS (SELECT employee_id, min(rn) FILTER (kind = 'add') AS added, min(rn) FILTER (kind = 'self') AS own, min(rn) FILTER (kind IN ('add', 'self')) AS made FROM o GROUP BY 1),
a AS (SELECT o.employee_id, min(rn) AS answered, arg_min(kind, rn) AS answer FROM o JOIN f USING (employee_id) WHERE kind IN ('accept', 'decline') AND rn > made AND (own IS NULL OR rn < own) GROUP BY 1)
SELECT event_id, employee_id, CASE kind WHEN 'self' THEN 'registered' WHEN 'add' THEN CASE WHEN rn = made THEN 'invited' ELSE 'present' END ELSE CASE WHEN made IS NULL OR rn < made THEN 'unknown' WHEN rn = answered THEN CASE kind WHEN 'accept' THEN 'accepted' ELSE 'declined' END ELSE 'handled' END END AS outcome,
  CASE WHEN rn >= own THEN 'accepted' WHEN rn >= answered THEN CASE answer WHEN 'accept' THEN 'accepted' ELSE 'declined' END WHEN rn >= made THEN 'pending' END AS status
FROM o JOIN f USING (employee_id) LEFT JOIN a USING (employee_id)""")
def community_optins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click', 'purchase') OR (event_type = 'signup' AND event_id % 7 = 0)")
    kind = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "accept").when(F.col("event_type") == "purchase", "decline").otherwise("self")
    return community.optins(e.select("event_id", F.col("user_id").alias("employee_id"), "ts", kind.alias("kind")))


@query("community_counts", f"""SELECT 'employees by status' AS metric, {_STATUS} AS part, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'employees by source', {_SOURCE}, count(*) FROM customer GROUP BY ALL
UNION ALL SELECT 'referrals by status', {_REFERRAL}, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'pool', 'total', count(*) FROM part""")
def community_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").selectExpr(f"{_STATUS} AS status", f"{_SOURCE} AS source")
    return community.counts(people, table(spark, sf_dir, "orders").selectExpr(f"{_REFERRAL} AS status"), table(spark, sf_dir, "part"))


#: SQL of a title, a model's answer and a rewritten document, the same for every engine.
_TITLE = "CASE p_partkey % 6 WHEN 0 THEN p_name || ' | LinkedIn Jobs here' WHEN 1 THEN p_name || ' - דרושים ועוד' WHEN 2 THEN 'Apply now: ' || p_name WHEN 3 THEN '  ' || repeat(p_name || ' & <b> ', 9) WHEN 4 THEN 'Save' ELSE p_brand || ' – Greenhouse' END"
_ANSWER = "CASE p_partkey % 4 WHEN 0 THEN chr(10) || '  - \"' || p_name || '\"' || chr(10) || 'more' WHEN 1 THEN '' WHEN 2 THEN '• «' || repeat(p_type || ' ', 30) || '»' ELSE p_type END"
_FINAL = "'[NAME]' || chr(10) || p_name || chr(10) || '[PROFILE]' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN '  ' ELSE p_type END || chr(10) || '[EXPERIENCE]' || chr(10) || CASE p_partkey % 4 WHEN 0 THEN '$ did' WHEN 1 THEN '' ELSE 'did' END || chr(10) || CASE p_partkey % 5 WHEN 0 THEN '' ELSE '[EDUCATION]' || chr(10) || 'school' || chr(10) || '[SKILLS]' || chr(10) || p_brand END"


def _section(mark: str) -> str:
    return _TRIM.format(f"regexp_extract(chr(10) || final || chr(10) || '[', '(?s)\\n\\s*\\[{mark}\\][ \\t]*\\n(.*?)\\n\\s*\\[', 1)")


@query("community_text_forms", f"""WITH t AS (SELECT p_partkey AS id, {_TITLE} AS title, {_ANSWER} AS answer, {_FINAL} AS final, repeat(p_name || ' ', 20 + p_size % 30) AS original, p_size FROM part),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(title, '(?i)\\s*[|–-]\\s*(LinkedIn|Indeed|Glassdoor|Drushim|AllJobs|JobMaster|Comeet|Greenhouse|Lever|Workable|SmartRecruiters|Gotfriends|HeyAnter|Jobify360|Nvidia Jobs|Jobs).*', ''), '\\s*[|–-]\\s*(דרושים|כל הג''ובים|ג''ובמסטר|חיפוש עבודה|משרות|לינקדאין).*', ''), '(?i)Apply.*$', '') AS a,
  regexp_replace(coalesce(list_filter(list_transform(string_split(answer, chr(10)), lambda x: {_TRIM.format("x")}), lambda x: x <> '')[1], ''), '^[•\\-–—*·]\\s*', '') AS b,
  list_transform(['NAME', 'PROFILE', 'EXPERIENCE', 'EDUCATION', 'SKILLS'], lambda x: x) AS marks, [{", ".join(_section(m) for m in ("NAME", "PROFILE", "EXPERIENCE", "EDUCATION", "SKILLS"))}] AS said FROM t)
SELECT id, {_TRIM.format("a")}[:80] AS page_title, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, {_TRIM.format("regexp_replace(b, '^[" + '"' + "''“”«»]+|[" + '"' + "''“”«»]+$', '', 'g')")}[:240] AS polished,
  len(title) >= 5 AND NOT regexp_matches({_TRIM.format("title")}, '(?i)^(עדכן|הוסף|חדש|מחק|שמור|בטל|צור|הגש|קרא|פתח|update|add|new|delete|save|cancel|submit|apply|sign|log|register|view|read)') AND len(answer) >= 15 AS is_card,
  CASE p_size % 3 WHEN 0 THEN p_size % 2 = 0 WHEN 1 THEN p_size % 4 < 2 ELSE false END AS light,
  array_to_string(list_concat(list_filter(list_transform(marks, lambda x, i: CASE WHEN said[i] = '' THEN 'missing_or_empty:[' || x || ']' END), lambda x: x IS NOT NULL), CASE WHEN said[3] <> '' AND NOT contains(said[3], '$ ') THEN ['experience_has_no_bullets'] ELSE [] END,
    CASE WHEN len({_TRIM.format("original")}) > 300 AND len({_TRIM.format("final")}) < len({_TRIM.format("original")}) * 0.25 THEN ['drastic_shrink orig_chars=' || len({_TRIM.format("original")}) || ' final_chars=' || len({_TRIM.format("final")})] ELSE [] END), '|') AS issues FROM u""")
def community_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{_TITLE} AS title", f"{_ANSWER} AS answer", f"{_FINAL} AS final", "repeat(p_name || ' ', 20 + p_size % 30) AS original", "p_size")
    fit = F.when(F.col("p_size") % 3 == 0, "high_fit").when(F.col("p_size") % 3 == 1, "niche_fit").otherwise("other")
    none, some = F.array().cast("array<string>"), F.array(F.lit("light"), F.when(F.col("p_size") % 4 < 2, "keep"))
    impacts = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, none).otherwise(some)).otherwise(some)
    c = F.col
    return rows.select(
        "id", community.page_title(c("title")).alias("page_title"), community.escaped(c("title")).alias("escaped"), community.polished(c("answer")).alias("polished"), community.is_card(c("title"), c("answer")).alias("is_card"),
        community.light_polish(fit, impacts).alias("light"), F.array_join(community.output_issues(c("final"), c("original")), "|").alias("issues"),
    )


@query("community_contributions", f"""SELECT page_id, regexp_matches(url, '(?i)^https?://') AND len(html) >= 350 AND len(list_filter([{", ".join("'" + x.replace("'", "''") + "'" for x in T.SIGNALS)}], lambda x: contains(lower(html), x))) > 0 AS accepted FROM pages""")
def community_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", community.is_contribution(F.col("url"), F.col("html")).alias("accepted"))
