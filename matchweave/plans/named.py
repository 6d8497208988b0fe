"""Queries over postings and profiles that name products beside the lexicon's terms, with SQL of their own constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.operators import matcher, named_terms
from matchweave.plans import inputs
from matchweave.plans.inputs import table
from matchweave.plans.registry import query

#: Products that the generated vacancies and profiles name.
PRODUCTS = ("DataPower", "IBM API Connect", "RabbitMQ", "SQL Server", "Kong Gateway", "Express", "C++", "Temporal", "vector search", "Agile", "ברוקר")


def product(number: str) -> str:
    """SQL for the product of a number."""
    return f"CASE ({number}) % {len(PRODUCTS)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRODUCTS)) + " END"


LINES = (
    f"'- Experience with ' || {product('p_partkey')} || ' or ' || {product('p_partkey * 3 + 1')}",
    f"'ניסיון ב-' || {product('p_partkey * 7 + 2')} || ' חובה'",
    f"CASE p_partkey % 4 WHEN 0 THEN 'Familiarity with git and agile tools' WHEN 1 THEN '- ' || (1 + p_size % 5) || ' years of ' || {product('p_partkey * 5 + 3')} || 's' ELSE 'Knowledge of Temporal Clouds, ' || {product('p_partkey + 4')} || ' and APIs' END",
)
TEXT = " || chr(10) || ".join((*inputs.POSTING_LINES[:5], *LINES, *inputs.POSTING_LINES[5:]))
VACANCIES = f"vacancies AS (SELECT p_partkey AS posting_id, {TEXT} AS text FROM part)"


def vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, text: a posting for each part that names products."""
    return inputs.dealt(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey AS posting_id", f"{TEXT} AS text")


def candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, summary and tools of a profile for each nation: its lexicon terms, then three products with tags."""
    entries, summary = inputs.profile_tables(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("profile_id"))
    order = F.row_number().over(matcher.Window.partitionBy("profile_id").orderBy("domain", "tech", "industry", "personal"))
    more = n.select("profile_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    more = more.selectExpr(
        "profile_id", "100 + j AS seq", "element_at(array('backend', 'devops_cloud', 'data_bi'), j + 1) AS domain", f"{product('profile_id * 2 + j * 3')} AS tech", "CAST(j AS double) AS industry", "CAST(profile_id % 3 AS double) AS personal", "CAST(null AS int) AS weight", f"array({product('profile_id + j + 5')}, 'api', 'jira') AS tags"
    )
    tools = n.selectExpr("profile_id", "explode(array(named_struct('tool', 'git', 'found', profile_id % 2 = 0, 'tags', CAST(null AS array<string>)), named_struct('tool', 'agile', 'found', false, 'tags', array('RabbitMQ')))) AS t").where("profile_id % 3 > 0")
    return entries.withColumn("seq", order).unionByName(more), summary, tools.select("profile_id", "t.tool", "t.found", "t.tags")


_HITS = f"""WITH {VACANCIES}, l AS (SELECT posting_id, unnest(generate_series(1, len(a))) - 1 AS line_no, unnest(a) AS line FROM (SELECT posting_id, string_split(text, chr(10)) AS a FROM vacancies)),
named AS (SELECT n_nationkey, j, {product("n_nationkey * 2 + j * 3")} AS tech, {product("n_nationkey + j + 5")} AS tag FROM nation, generate_series(0, 2) s(j)),
terms AS (SELECT lower(tech) AS term FROM named UNION SELECT lower(tag) FROM named UNION SELECT 'jira'),
patterns AS (SELECT term, CASE WHEN regexp_matches(term, '[\\x{{0590}}-\\x{{05FF}}]') THEN NULL ELSE
  CASE WHEN regexp_matches(term, '^[a-z0-9]') THEN '(^|[^a-z0-9.])' ELSE '' END || replace(replace(term, '+', '\\+'), '.', '\\.') ||
  CASE WHEN NOT regexp_matches(term, '[a-z0-9]$') THEN '' WHEN term LIKE '%s' THEN '([^a-z0-9]|$)' ELSE 's?([^a-z0-9]|$)' END END AS pattern FROM terms)
SELECT DISTINCT posting_id, line_no::INTEGER AS line_no, term FROM l JOIN patterns ON CASE WHEN pattern IS NULL THEN contains(lower(line), term) ELSE regexp_matches(lower(line), pattern) END"""


@query("match_profile_terms", _HITS)
def match_profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names and specific tags of all profiles' products in every line, through the index of first words."""
    lines = vacancies(spark, sf_dir).select("posting_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("posting_id", "line_no", F.lower("line").alias("low"))
    entries = candidates(spark, sf_dir)[0].where("seq >= 100")
    return named_terms.term_hits(lines, named_terms._entry_terms(entries)[1])


_UNKNOWN = rf"""WITH {VACANCIES}, l AS (SELECT posting_id, unnest(generate_series(1, len(a))) - 1 AS line_no, unnest(a) AS line FROM (SELECT posting_id, string_split(text, chr(10)) AS a FROM vacancies)),
t AS (SELECT posting_id, line_no, unnest(w) AS term, unnest(generate_series(1, len(w))) AS nth FROM (SELECT posting_id, line_no, regexp_extract_all(line, '\b(?:[A-Z][A-Za-z0-9]*|[A-Z]{{2,}})(?:[\s-]+(?:[A-Z][A-Za-z0-9]*|[A-Z]{{2,}})){{0,3}}\b') AS w FROM l
  WHERE regexp_matches(line, '[\x{{0590}}-\x{{05FF}}]') OR regexp_matches(line, '(?i)^[-*•\s]*(experience (with|in|building|integrating|deploying|working)|familiarity with|knowledge of|background in|proficiency in|proven experience (with|in|building)?|strong (background|experience) (with|in)|understanding of)\b')))
SELECT posting_id, line_no::INTEGER AS line_no, string_agg(term, '|' ORDER BY nth) AS terms FROM t WHERE len(term) >= 2 AND lower(term) NOT IN ('api', 'apis', 'sql', 'experience', 'familiarity', 'knowledge', 'agile', 'git') GROUP BY ALL"""


@query("match_unknown_terms", _UNKNOWN)
def match_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capitalised terms of lines that ask for experience, joined by bars."""
    lines = vacancies(spark, sf_dir).select("posting_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("posting_id", "line_no", F.array_join(named_terms.unknown_terms(F.col("line")), "|").alias("terms")).where("terms <> ''")


@query("match_profile_scores")
def match_profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile against every vacancy, with profile terms, unknown terms, tools and bullets."""
    scored = named_terms.scores(vacancies(spark, sf_dir), *candidates(spark, sf_dir))
    return scored.withColumns({c: F.array_join(c, "|") for c in ("matched", "missing", "bullets")})
