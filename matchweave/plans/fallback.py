"""Queries of profiles read from texts alone, with SQL of their own constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchweave.operators import fallback_profile
from matchweave.plans.inputs import dealt, pick, table
from matchweave.plans.registry import query

#: SQL of the text of a person, the same for every engine.
PERSON = (
    f"CASE c_custkey % 5 WHEN 0 THEN '' ELSE c_name || ' has ' || CASE c_custkey % 3 WHEN 0 THEN (2 + c_custkey % 9) || '+ years of professional experience. ' WHEN 1 THEN (1 + c_custkey % 4) || ' שנות ניסיון. ' ELSE 'no figures. ' END"
    f" || repeat('long story ', CAST(c_custkey % 29 AS INT)) || {pick('c_custkey')} || ' for ' || (1 + c_custkey % 6) || '.5 yrs, ' || repeat('and more ', CAST(c_custkey % 31 AS INT)) || 'Golang/' || {pick('c_custkey * 3 + 1')} || ' and ASP.NET, node.js; ' || {pick('c_custkey * 7 + 2')} || CASE c_custkey % 2 WHEN 0 THEN '' ELSE 's' END END"
)
_TERMS = (
    "VALUES " + ", ".join(f"('backend', '{t}')" for t in ("java", "c#", ".net", "python", "ruby", "go", "golang", "rust", "php", "scala", "kotlin", "node.js", "nodejs"))
    + ", " + ", ".join(f"('frontend', '{t}')" for t in ("react", "vue", "angular", "next.js", "nextjs", "javascript", "typescript"))
    + ", ('ai_ml_llm', 'tensorflow'), ('ai_ml_llm', 'pytorch'), ('ai_ml_llm', 'machine learning'), ('data_bi', 'spark'), ('data_bi', 'sql'), ('data_bi', 'postgresql'), ('data_bi', 'pandas')"
    + ", ('devops_cloud', 'docker'), ('devops_cloud', 'kubernetes'), ('devops_cloud', 'aws'), ('devops_cloud', 'azure'), ('devops_cloud', 'gcp'), ('devops_cloud', 'terraform'), ('mobile', 'swift'), ('mobile', 'flutter'), ('mobile', 'react native'), ('mobile', 'android')"
)
ENTRIES = f"""WITH p AS (SELECT c_custkey AS profile_id, lower({PERSON}) AS low FROM customer), terms(domain, tech) AS ({_TERMS}), t AS (SELECT *, '(^|[^a-z0-9])' || replace(tech, '.', '\\.') AS l, replace(tech, '.', '\\.') || '([^a-z0-9]|$)' AS r FROM terms),
y AS (SELECT profile_id, low, coalesce(nullif(regexp_extract(low, '(\\d+)\\+?\\s*years?\\s*(?:of\\s*)?(?:professional\\s*)?experience', 1), ''), nullif(regexp_extract(low, '(\\d+)\\s*שנות?\\s*ניסיון', 1), ''), '0')::DOUBLE AS total FROM p),
m AS (SELECT profile_id, low, total, domain, tech, CASE WHEN regexp_matches(low, '^' || r) THEN 0 ELSE len(string_split_regex(low, l || '([^a-z0-9]|$)')[1]) + 1 END AS place FROM y JOIN t ON contains(low, tech) AND regexp_matches(low, l || '([^a-z0-9]|$)')),
e AS (SELECT profile_id, domain, tech, coalesce(nullif(regexp_extract(low[greatest(1, place - 149):place + 150], '(\\d+(?:\\.\\d+)?)\\s*(?:\\+)?\\s*(?:years?|yrs?|שנות?)', 1), '')::DOUBLE, CASE WHEN total > 0 THEN total * 5 / 10 END, 1) AS industry, total FROM m)
"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey AS profile_id", f"{PERSON} AS text")


@query("match_fallback_entries", ENTRIES + "SELECT * FROM e")
def match_fallback_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_profile.entries(_people(spark, sf_dir))


@query("match_fallback_domains", ENTRIES + "SELECT profile_id, domain, sum(industry) AS years FROM e GROUP BY ALL")
def match_fallback_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_profile.domain_years(fallback_profile.entries(_people(spark, sf_dir)))
