"""Profiles of people who have none: terms and years read from the text of a document alone.

Each known term is looked for once in a text; its years are the first figure within 150 characters of its first mention, else half
the years the text claims in all, else one. Everything is an expression of the row; nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms by domain, patterns.
TERMS = {
    "backend": ("java", "c#", ".net", "python", "ruby", "go", "golang", "rust", "php", "scala", "kotlin", "node.js", "nodejs"),
    "frontend": ("react", "vue", "angular", "next.js", "nextjs", "javascript", "typescript"),
    "ai_ml_llm": ("tensorflow", "pytorch", "machine learning"),
    "data_bi": ("spark", "sql", "postgresql", "pandas"),
    "devops_cloud": ("docker", "kubernetes", "aws", "azure", "gcp", "terraform"),
    "mobile": ("swift", "flutter", "react native", "android"),
}
TOTAL = (r"(\d+)\+?\s*years?\s*(?:of\s*)?(?:professional\s*)?experience", r"(\d+)\s*שנות?\s*ניסיון")
YEARS = r"(\d+(?:\.\d+)?)\s*(?:\+)?\s*(?:years?|yrs?|שנות?)"
AROUND = 150


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double")


def entries(texts: DataFrame) -> DataFrame:
    """profile_id, domain, tech, industry, total of ``texts`` (profile_id, text): a row for each term that the text names. A null or
    empty text names none."""
    rows = texts.select("profile_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = rows.withColumn("total", F.coalesce(*[_number(F.col("low"), p) for p in TOTAL], F.lit(0.0)))
    found = []
    for domain, terms in TERMS.items():
        for term in terms:
            # the pattern runs only where the term occurs at all
            at = F.when(F.contains("low", F.lit(term)), F.regexp_instr("low", F.lit(f"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")))
            found.append(F.struct(F.lit(domain).alias("domain"), F.lit(term).alias("tech"), at.alias("at")))
    rows = rows.select("profile_id", "low", "total", F.explode(F.filter(F.array(*found), lambda x: x["at"] > 0)).alias("x"))
    begin = F.greatest(F.lit(1), F.col("x.at") - AROUND)
    near = F.substring(F.col("low"), begin, F.col("x.at") + AROUND - begin)
    industry = F.coalesce(_number(near, YEARS), F.when(F.col("total") > 0, F.round(F.col("total") * 5) / 10), F.lit(1.0))
    return rows.select("profile_id", "x.domain", "x.tech", industry.alias("industry"), "total")


def domain_years(told: DataFrame) -> DataFrame:
    """profile_id, domain, years: the years of a domain's terms added up (a full profile takes the most instead)."""
    return told.groupBy("profile_id", "domain").agg(F.sum("industry").alias("years"))


def profile_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, summary and tools as ``named_terms.scores`` takes them; there are no tools and no tags."""
    told = entries(texts)
    order = F.row_number().over(Window.partitionBy("profile_id").orderBy("domain", "tech"))
    rows = told.select("profile_id", order.alias("seq"), "domain", "tech", "industry", F.lit(0.0).alias("personal"), F.lit(0).alias("weight"), F.array().cast("array<string>").alias("tags"))
    low = F.lower(F.coalesce("text", F.lit("")))
    per = domain_years(told).groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("domain", "years"))).alias("domain_years"))
    summary = texts.select("profile_id", F.coalesce(*[_number(low, p) for p in TOTAL], F.lit(0.0)).alias("total_years")).join(per, "profile_id", "left")
    tools = texts.select("profile_id", F.lit("").alias("tool"), F.lit(False).alias("found"), F.array().cast("array<string>").alias("tags")).where("false")
    return rows, summary, tools
