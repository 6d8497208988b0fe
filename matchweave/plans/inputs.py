"""Inputs of the registered queries, derived from the shared tables by expressions that SQL engines share.

Every view has its Spark form here and its SQL form in ``CTES``, so a query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.operators.directory import WEBMAIL

#: Fixed "now" of the queries: results must not depend on the clock.
NOW = "2024-01-31 00:00:00"
#: Points of each action.
POINTS = {"signup": 10, "view": 2, "click": -1, "purchase": -5, "error": 5}
ACTIONS = {"click": "email_open", "purchase": "referral_request", "error": "refund"}
#: Additions and enrichments, of recruiters for even events, of employees for odd ones.
RECORDS = {"signup": "added_new", "view": "enriched"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows spread over all tasks by ``key``. For what is made of them row by row: a table of numbers is a small file, which
    one task reads, and the texts made from it are many times as large."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _case(column: str, values: dict[str, object]):
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(F.col(column) == k, F.lit(v))
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, user_id, action, delta, ref_id, ts: the append-only points ledger."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("entry_id"), "user_id", F.coalesce(_case("event_type", ACTIONS), F.concat(F.when(F.col("event_id") % 2 == 0, "recruiter_").otherwise("employee_"), _case("event_type", RECORDS))).alias("action"), _case("event_type", POINTS).cast("long").alias("delta"), (F.col("event_id") % 997).alias("ref_id"), "ts")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """click_id, app_id, target, ts: clicks on tracked links."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'")
    target = F.when(F.col("event_id") % 3 == 0, "github").when(F.col("event_id") % 3 == 1, "linkedin").otherwise("portfolio")
    return e.select(F.col("event_id").alias("click_id"), F.col("user_id").alias("app_id"), target.alias("target"), "ts")


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, app_id, status, score, cv_generated, platform, ts: tracked applications, job_id in order of saving."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "submitted").when(F.col("o_orderstatus") == "P", "generated").otherwise("viewed")
    score = F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.floor(F.col("o_totalprice")) % 101)
    platform = F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 17 == 0, "  ").otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("app_id"), status.alias("status"), score.cast("long").alias("score"), (F.col("o_orderkey") % 3 == 0).alias("cv_generated"), platform.alias("platform"), F.col("o_orderdate").alias("ts"))


def directory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, full_name, email, company, phone, verified, domains, threshold, opt_in: noisy directory contributions in order."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    who = (k % 400).cast("string")
    email = F.when(k % 3 == 0, F.concat(F.lit("  User"), who, F.lit("@Acme.com "))).when(k % 10 == 7, F.concat(F.lit("user"), who, F.lit("@"), F.element_at(F.array(*map(F.lit, WEBMAIL)), (F.floor(k / 10) % len(WEBMAIL) + 1).cast("int")))).when(k % 41 == 5, F.concat(F.lit("user"), who)).otherwise(F.concat(F.lit("user"), who, F.lit("@acme.com")))
    company = F.concat(F.lit("  Acme "), F.lit("  "), (k % 40).cast("string"), F.lit(" Corp\t"))
    return c.select(
        k.alias("seq"),
        F.when(k % 5 == 0, None).when(k % 7 == 0, "  ").otherwise(F.col("c_name")).alias("full_name"),
        email.alias("email"),
        company.alias("company"),
        F.when(k % 4 == 0, F.concat(F.lit("+1-"), k.cast("string"))).alias("phone"),
        (k % 19 == 0).alias("verified"),
        F.when(k % 6 == 0, "data; backend ,, ").when(k % 6 == 1, " ; ").otherwise(F.col("c_mktsegment")).alias("domains"),
        F.when(k % 8 == 0, "80.7").when(k % 8 == 1, "-3").when(k % 8 == 2, "n/a").when(k % 8 == 3, "60").alias("threshold"),
        F.when(k % 3 == 1, "yes").when(k % 3 == 2, "  ").alias("opt_in"),
    )


#: Terms that the generated postings and profiles name.
TERMS = ("python", "java", "react", "docker", "kubernetes", "sql", "postgresql", "go", "express", "rest", "node.js", "c#", "machine learning", "react native", "aws", "spark", ".net", "ios", "pytorch", "selenium")


def pick(number: str) -> str:
    """SQL for the term of a number."""
    return f"CASE ({number}) % {len(TERMS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TERMS)) + " END"


#: SQL of the lines of the posting of a part, the same for every engine.
POSTING_LINES = (
    "CASE p_partkey % 4 WHEN 0 THEN 'Senior Backend Developer' WHEN 1 THEN 'Full Stack Engineer' WHEN 2 THEN 'Data Analyst at acme' ELSE 'Mobile developer wanted' END",
    "'About us:'",
    "'We build things with java and kafka for many happy customers everywhere.'",
    "CASE p_partkey % 5 WHEN 0 THEN 'We offer a friendly place to grow and to learn new things' WHEN 1 THEN 'Requirements:' WHEN 2 THEN 'דרישות:' WHEN 3 THEN 'What you will need, qualifications' ELSE 'Qualifications' END",
    f"'- ' || (1 + p_size % 7) || '+ years of ' || {pick('p_partkey')} || ' experience'",
    f"'- Experience with ' || {pick('p_partkey * 3 + 1')} || ' or ' || {pick('p_partkey * 7 + 2')}",
    f"CASE p_partkey % 3 WHEN 0 THEN '- 3 years of backend development experience' WHEN 1 THEN '- 2-4 years of ' || {pick('p_partkey')} || ' in a production environment' ELSE '- 5 years of hands-on experience in the field' END",
    f"'- ' || {pick('p_partkey * 5 + 3')} || ' skills - ' || CASE p_partkey % 2 WHEN 0 THEN 'advantage' ELSE 'must' END",
    "CASE p_partkey % 6 WHEN 0 THEN 'Nice to have:' WHEN 1 THEN 'יתרון משמעותי:' ELSE 'Frontend and mobile apps knowledge is good' END",
    f"'- ' || {pick('p_partkey * 11 + 4')} || ', 2 years'",
)
POSTING_TEXT = " || chr(10) || ".join(POSTING_LINES)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, text: a posting for each part."""
    return dealt(table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey AS posting_id", f"{POSTING_TEXT} AS text")


#: SQL of the text of the marked document of a supplier.
CV_TEXT = " || chr(10) || ".join((
    "'[PROFILE]'", "s_name || ' builds reliable systems'", "'[EXPERIENCE]'", "'Engineer | Acme ' || (s_suppkey % 9) || ' | 2019'", "'in a small team'",
    f"'- moved services to ' || {pick('s_suppkey')}", f"'- wrote ' || {pick('s_suppkey * 3 + 1')} || ' jobs for ' || (s_suppkey % 5) || ' teams'", "'Consulting'", "'- trained users'", "'[LANGUAGES]'", "'English'",
))


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a document with marked sections for each supplier."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS doc_id", f"{CV_TEXT} AS text")


def profile_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A candidate profile for each nation: entries (profile_id, domain, tech, industry, personal, weight, tags) and summary."""
    from matchweave.operators.matcher import DOMAIN_OF

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("profile_id"))
    rows = n.select("profile_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    rows = rows.selectExpr("profile_id", "j", f"{pick('profile_id * 3 + j * 4')} AS tech", f"array({pick('profile_id + j')}) AS tags")
    domain = F.element_at(F.create_map(*[F.lit(x) for t in TERMS for x in (t, DOMAIN_OF[t])]), F.col("tech"))
    entries = rows.select("profile_id", domain.alias("domain"), "tech", ((F.col("profile_id") + F.col("j")) % 6 * 0.5).alias("industry"), (F.col("j") % 4).cast("double").alias("personal"), F.when(F.col("j") % 2 == 0, F.col("j") * 20).alias("weight"), "tags")
    return entries, n.select("profile_id", (F.col("profile_id") % 9).cast("double").alias("total_years"))


#: The same views in SQL.
CTES = {
    "cvs": f"cvs AS (SELECT s_suppkey AS doc_id, {CV_TEXT} AS text FROM supplier)",
    "postings": f"postings AS (SELECT p_partkey AS posting_id, {POSTING_TEXT} AS text FROM part)",
    "ledger": """ledger AS (SELECT event_id AS entry_id, user_id,
      CASE event_type WHEN 'click' THEN 'email_open' WHEN 'purchase' THEN 'referral_request' WHEN 'error' THEN 'refund'
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'recruiter_added_new' ELSE 'employee_added_new' END
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'recruiter_enriched' ELSE 'employee_enriched' END END AS action,
      CASE event_type WHEN 'signup' THEN 10 WHEN 'view' THEN 2 WHEN 'click' THEN -1 WHEN 'purchase' THEN -5 WHEN 'error' THEN 5 END::BIGINT AS delta,
      event_id % 997 AS ref_id, ts FROM events)""",
    "clicks": """clicks AS (SELECT event_id AS click_id, user_id AS app_id,
      CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'linkedin' ELSE 'portfolio' END AS target, ts FROM events WHERE event_type = 'click')""",
    "tracked": """tracked AS (SELECT o_orderkey AS job_id, o_custkey AS app_id,
      CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'generated' ELSE 'viewed' END AS status,
      CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice)::BIGINT % 101 END AS score,
      o_orderkey % 3 = 0 AS cv_generated,
      CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS platform, o_orderdate AS ts FROM orders)""",
    "directory_rows": """directory_rows AS (SELECT c_custkey AS seq,
      CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS full_name,
      CASE WHEN c_custkey % 3 = 0 THEN '  User' || (c_custkey % 400) || '@Acme.com ' WHEN c_custkey % 10 = 7 THEN 'user' || (c_custkey % 400) || '@' || ['gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'hotmail.co.il', 'live.com', 'msn.com', 'yahoo.com', 'yahoo.co.il', 'walla.co.il', 'walla.com', 'icloud.com', 'me.com', 'aol.com'][(c_custkey // 10) % 14 + 1]
           WHEN c_custkey % 41 = 5 THEN 'user' || (c_custkey % 400) ELSE 'user' || (c_custkey % 400) || '@acme.com' END AS email,
      '  Acme   ' || (c_custkey % 40) || ' Corp' || chr(9) AS company,
      CASE WHEN c_custkey % 4 = 0 THEN '+1-' || c_custkey END AS phone, c_custkey % 19 = 0 AS verified,
      CASE c_custkey % 6 WHEN 0 THEN 'data; backend ,, ' WHEN 1 THEN ' ; ' ELSE c_mktsegment END AS domains,
      CASE c_custkey % 8 WHEN 0 THEN '80.7' WHEN 1 THEN '-3' WHEN 2 THEN 'n/a' WHEN 3 THEN '60' END AS threshold,
      CASE c_custkey % 3 WHEN 1 THEN 'yes' WHEN 2 THEN '  ' END AS opt_in FROM customer)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names) + "\n"
