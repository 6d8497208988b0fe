"""Employees that a community adds: upserts, opt-in transitions, counts by grouping sets, and small text forms of their pages.

An e-mail's or employee's rows form one window in order; what came before is a running value in it, so nothing is gathered, and one
employee is one task by its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators.directory import EMAIL

#: Site names that end page titles, verbs of buttons, marks of sections that a document must fill.
SITES = r"(?i)\s*[|–-]\s*(LinkedIn|Indeed|Glassdoor|Drushim|AllJobs|JobMaster|Comeet|Greenhouse|Lever|Workable|SmartRecruiters|Gotfriends|HeyAnter|Jobify360|Nvidia Jobs|Jobs).*"
SITES_HEBREW = r"\s*[|–-]\s*(דרושים|כל הג'ובים|ג'ובמסטר|חיפוש עבודה|משרות|לינקדאין).*"
BUTTONS = r"(?i)^(עדכן|הוסף|חדש|מחק|שמור|בטל|צור|הגש|קרא|פתח|update|add|new|delete|save|cancel|submit|apply|sign|log|register|view|read)"
NEEDED = ("[NAME]", "[PROFILE]", "[EXPERIENCE]", "[EDUCATION]", "[SKILLS]")


def _told(rows: DataFrame) -> DataFrame:
    name, company, email = T.stripped(F.coalesce("full_name", F.lit(""))), T.stripped(F.coalesce("company", F.lit(""))), T.normalized_email(F.coalesce("email", F.lit("")))
    rows = rows.select("seq", name.alias("full_name"), company.alias("company"), email.alias("email"), T.domain_list(F.col("domains")).alias("domains"), F.col("threshold").try_cast("double").cast("int").alias("threshold"))
    bad = F.when((F.col("full_name") == "") | (F.col("company") == ""), "no_name").when(~F.col("email").rlike(EMAIL), "bad_email")
    return rows.withColumns({"bad": bad, "threshold": F.when(F.col("threshold") > 0, F.col("threshold")).otherwise(75)})


def employee_outcomes(rows: DataFrame) -> DataFrame:
    """seq, email, outcome of each contribution in order: no_name, bad_email, created, enriched (missing domains come in) or
    duplicate. A name is never missing after the first row; the state of the opt-in is never touched. Webmail is welcome."""
    rows = _told(rows)
    good = rows.where("bad IS NULL")
    before = Window.partitionBy("email").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fills = F.col("domains").isNotNull() & ~F.coalesce(F.max(F.col("domains").isNotNull()).over(before), F.lit(False))
    outcome = F.when(F.count("*").over(before) == 0, "created").when(fills, "enriched").otherwise("duplicate")
    return good.select("seq", "email", outcome.alias("outcome")).unionByName(rows.where("bad IS NOT NULL").select("seq", "email", F.col("bad").alias("outcome")))


def employees(rows: DataFrame) -> DataFrame:
    """email, full_name, company, company_key, threshold of the first valid contribution, and the first domains given."""
    rows = _told(rows).where("bad IS NULL")
    first = F.min_by(F.struct("full_name", "company", "threshold"), "seq").alias("f")
    out = rows.groupBy("email").agg(first, F.min_by("domains", F.when(F.col("domains").isNotNull(), F.col("seq"))).alias("domains"))
    return out.select("email", "f.full_name", "f.company", T.normalized_company(F.col("f.company")).alias("company_key"), "f.threshold", "domains")


def optins(events: DataFrame) -> DataFrame:
    """event_id, employee_id, outcome, status after it, for events (event_id, employee_id, ts, kind: add, self, accept, decline).

    An added employee is pending until the first answer counts; a self-registration accepts whatever was before. Answers of unknown
    employees are unknown, later ones already handled; who declined is not invited again by another addition."""
    w = Window.partitionBy("employee_id").orderBy("ts", "event_id")
    before, until = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    ever = lambda c, over: F.coalesce(F.max(c).over(over), F.lit(False))
    kind = F.col("kind")
    rows = events.where("employee_id IS NOT NULL").withColumns({"known": ever(kind.isin("add", "self"), before), "own": ever(kind == "self", before)})
    rows = rows.withColumn("answer", F.when(kind.isin("accept", "decline") & F.col("known") & ~F.col("own"), kind))
    rows = rows.withColumns({"first": F.first("answer", ignorenulls=True).over(until), "answered": F.first("answer", ignorenulls=True).over(before).isNotNull()})
    outcome = (
        F.when(kind == "self", "registered")
        .when(kind == "add", F.when(F.col("known"), "present").otherwise("invited"))
        .when(~F.col("known"), "unknown")
        .when(F.col("own") | F.col("answered"), "handled")
        .otherwise(F.when(kind == "accept", "accepted").otherwise("declined"))
    )
    status = F.when(F.col("own") | (kind == "self"), "accepted").when(F.col("first") == "accept", "accepted").when(F.col("first") == "decline", "declined").when(F.col("known") | (kind == "add"), "pending")
    return rows.select("event_id", "employee_id", outcome.alias("outcome"), status.alias("status"))


def counts(people: DataFrame, referrals: DataFrame, pool: DataFrame) -> DataFrame:
    """metric, part, n: employees by opt-in status and by source in one scan, referrals by status, and the size of the pool."""
    by = people.groupingSets([["status"], ["source"]], "status", "source").agg(F.grouping("status").alias("g"), F.count("*").alias("n"))
    told = by.select(F.when(F.col("g") == 0, "employees by status").otherwise("employees by source").alias("metric"), F.when(F.col("g") == 0, F.col("status")).otherwise(F.col("source")).alias("part"), "n")
    states = referrals.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("referrals by status").alias("metric"), F.col("status").alias("part"), "n")
    return told.union(states).union(pool.agg(F.count("*").alias("n")).select(F.lit("pool"), F.lit("total"), "n"))


def page_title(x: Column) -> Column:
    """A page's title without the site's name and what follows an Apply, at most 80 characters; null: empty."""
    s = F.regexp_replace(F.coalesce(x, F.lit("")), SITES, "")
    s = F.regexp_replace(F.regexp_replace(s, SITES_HEBREW, ""), "(?i)Apply.*$", "")
    return F.substring(T.stripped(s), 1, 80)


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def polished(x: Column) -> Column:
    """The first line that isn't blank, without bullet and quotes around it, at most 240 characters; null: empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), "\n"), T.stripped), lambda s: s != "")
    s = F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"^[•\-–—*·]\s*", "")
    return F.substring(T.stripped(F.regexp_replace(s, "^[\"'“”«»]+|[\"'“”«»]+$", "")), 1, 240)


def is_card(title: Column, text: Column) -> Column:
    """Whether a card of a list is an offer: a title of 5 characters or more that is no button, and 15 of text."""
    return F.coalesce((F.length(title) >= 5) & ~T.stripped(title).rlike(BUTTONS) & (F.length(text) >= 15), F.lit(False))


def is_contribution(url: Column, text: Column) -> Column:
    """Whether a fetched page may enter the pool: an http address, 350 characters or more, and words of requirements."""
    return F.coalesce(url.rlike("(?i)^https?://") & (F.length(text) >= 350) & T.has_signal(text), F.lit(False))


def light_polish(fit_type: Column, impacts: Column) -> Column:
    """Whether a document only needs light polishing: a high fit without choices, or a niche fit whose choices (an array of
    impacts, null ones structural) are all keep or light."""
    none = F.coalesce(F.size(F.when(impacts.isNotNull(), impacts)) == 0, F.lit(True))
    light = ~none & F.forall(impacts, lambda c: F.coalesce(c, F.lit("structural")).isin("keep", "light"))
    return ((fit_type == "high_fit") & none) | ((fit_type == "niche_fit") & light)


def output_issues(final: Column, original: Column) -> Column:
    """Codes of what a rewritten document seems to have lost, from its text and the original's: sections that are missing or
    empty, experience without bullets, less than a quarter of the length. Sections end at the next marked line."""
    section = lambda m: T.stripped(F.regexp_extract(F.concat(F.lit("\n"), final, F.lit("\n[")), r"(?s)\n\s*" + m.replace("[", r"\[").replace("]", r"\]") + r"[ \t]*\n(.*?)\n\s*\[", 1))
    size, was = F.length(T.stripped(final)), F.length(T.stripped(original))
    codes = [F.when(section(m) == "", f"missing_or_empty:{m}") for m in NEEDED]
    codes.append(F.when((section("[EXPERIENCE]") != "") & ~section("[EXPERIENCE]").contains("$ "), "experience_has_no_bullets"))
    codes.append(F.when((was > 300) & (size < was * 0.25), F.concat(F.lit("drastic_shrink orig_chars="), was, F.lit(" final_chars="), size)))
    return F.filter(F.array(*codes), lambda c: c.isNotNull())
