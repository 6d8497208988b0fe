"""Scalar text functions as column expressions."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

HEBREW = "[֐-׿]"


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalized_email(x: Column) -> Column:
    return F.lower(stripped(x))


def normalized_company(x: Column) -> Column:
    return stripped(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def domain_list(x: Column) -> Column:
    """Parts between ; and , without blanks; null if none is left."""
    parts = F.filter(F.transform(F.split(x, "[;,]"), stripped), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def threshold(x: Column, default: int = 75) -> Column:
    """The whole part of a number; the default where it is none or not positive."""
    n = F.try_to_number(x, F.lit("S9999999.99"))
    n = F.coalesce(x.try_cast("double"), n.cast("double"))
    return F.when(F.floor(n) > 0, F.floor(n)).otherwise(default).cast("int")


def ticked(x: Column) -> Column:
    return F.coalesce(stripped(x) != "", F.lit(False))


def cleaned(x: Column) -> Column:
    """Non-breaking spaces and tabs become spaces, runs of spaces one; lines are trimmed; of several blank lines one stays."""
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), "[\t  ]+", " ")
    return stripped(F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def html_to_text(x: Column) -> Column:
    """Plain text of markup by replacement only: scripts, styles and page furniture go, block tags end lines."""
    for tag in ("script", "style", "noscript", "svg", "template", "iframe", "nav", "header", "footer", "aside"):
        x = F.regexp_replace(x, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    x = F.regexp_replace(x, "(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<br[^>]*>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article)\b[^>]*>", "\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(mark))
    return cleaned(x)


def url_hash(x: Column) -> Column:
    """The 31-polynomial over UTF-16-like code points wrapped to 32 bits, absolute, in base 36 (ASCII addresses)."""
    total = F.aggregate(F.split(x, ""), F.lit(0).cast("long"), lambda a, c: (a * 31 + F.when(c == "", 0).otherwise(F.ascii(c))) % (1 << 32))
    total = F.when(total >= 1 << 31, (1 << 32) - total).otherwise(total)
    return F.lower(F.conv(total.cast("string"), 10, 36))


def stable_id(x: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(x, 256), 1, digits)


def hebrew_share(x: Column) -> Column:
    """Hebrew letters among the characters that are not white space."""
    solid = F.length(F.regexp_replace(x, r"\s", ""))
    return F.when(solid > 0, F.regexp_count(x, F.lit(HEBREW)) / solid).otherwise(0.0)


def language(x: Column) -> Column:
    return F.when(hebrew_share(x) > 0.2, "he").otherwise("en")


def host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[a-z]+://([^/:?#]+)", 1))


#: Fixed names of sites by what their host contains, the first that fits deciding.
PLATFORMS = (
    ("linkedin.com", "LinkedIn"), ("jobmaster.co.il", "JobMaster"), ("alljobs.co.il", "AllJobs"), ("indeed.com", "Indeed"), ("glassdoor.com", "Glassdoor"), ("drushim.co.il", "דרושים"),
    ("gotfriends.co.il", "גוטפרנדס"), ("comeet.co", "Comeet"), ("hunter.io", "Hunter"), ("heyanter.com", "הייאנטר"), ("jobify360.co.il", "Jobify360"), ("jobs.nvidia.com", "NVIDIA"),
    ("greenhouse.io", "Greenhouse"), ("lever.co", "Lever"), ("smartrecruiters.com", "SmartRecruiters"), ("workable.com", "Workable"), ("jobnet.co.il", "JobNet"), ("jobs.gov.il", "שירות התעסוקה"),
)


def site(x: Column) -> Column:
    """The host of an address without its first www."""
    return F.regexp_replace(host(x), r"^(.*?)www\.", "$1")


def platform(x: Column) -> Column:
    """The name of an address's site; its host where none is known."""
    s, out = site(x), F
    for part, name in PLATFORMS:
        out = out.when(s.contains(part), name)
    return out.otherwise(s)


#: Fixed list of phrases that show a requirements section.
SIGNALS = (
    "דרישות התפקיד", "דרישות המשרה", "דרישות:", "כישורים נדרשים", "ניסיון נדרש", "תיאור המשרה", "על התפקיד", "תחומי אחריות", "יתרון משמעותי", "חובה:",
    "requirements", "qualifications", "what you'll need", "what we're looking for", "what you'll do", "the role", "about the role", "responsibilities",
    "must have", "nice to have", "we are looking for", "bonus points", "skills",
)


def has_signal(x: Column) -> Column:
    low = F.translate(F.lower(F.coalesce(x, F.lit(""))), "‘’", "''")
    return functools.reduce(operator.or_, [F.contains(low, F.lit(s)) for s in SIGNALS])


#: Fixed lists of words that show a page of vacancies.
PAGE_WORDS = (
    ("משרה", "משרות", "תפקיד", "דרישות", "ניסיון", 'קו"ח', "גיוס", "פיתוח", "מפתח", "הגש"),
    ("job", "position", "vacancy", "career", "apply", "requirements", "experience", "hiring", "full-time", "part-time", "salary"),
)


def has_page_words(x: Column) -> Column:
    """Whether two of the Hebrew or three of the English words occur."""
    low = F.lower(F.coalesce(x, F.lit("")))
    # plain sums: a lambda would put the text in lower case again for each word
    hebrew, english = (functools.reduce(operator.add, [F.contains(low, F.lit(w)).cast("int") for w in words]) for words in PAGE_WORDS)
    return (hebrew >= 2) | (english >= 3)


def begins_in_hebrew(x: Column) -> Column:
    """Whether more than 15 Hebrew letters stand in the first 300 characters."""
    return F.coalesce(F.regexp_count(F.substring(x, 1, 300), F.lit(HEBREW)) > 15, F.lit(False))


#: Fixed patterns of addresses: of one vacancy, of lists, of a list with one vacancy open.
DETAIL_ADDRESS = r"(?i)/jobs?/view/|/viewjob\b|/job/[^/?#]+|/jobs/\d+|/position/[^/?#]+|/vacancy/[^/?#]+|/opening/[^/?#]+|/jobposting/|/o/[a-z0-9-]{6,}"
LIST_ADDRESS = r"(?i)/jobs/search|/jobs/collections|/job-search|/jobs/?($|[?#])|/careers/?($|[?#])|/positions/?($|[?#])|/openings/?($|[?#])|/vacancies|/search/?($|[?#])|[?&](q|keywords|query|search)="
OPEN_ADDRESS = r"(?i)[?&](currentJobId|selectedJobId|jk|vjk|jobId)=[^&#]+"


def page_kind(url: Column, has_pane: Column) -> Column:
    """single, hybrid or listing; an unknown address is a listing unless the page has a description pane."""
    detail, listed = url.rlike(DETAIL_ADDRESS), url.rlike(LIST_ADDRESS)
    return F.when(detail & ~listed, "single").when(listed & (has_pane | url.rlike(OPEN_ADDRESS)), "hybrid").when(listed, "listing").when(detail | has_pane, "single").otherwise("listing")


#: Fixed patterns of free-text answers, the first that fits deciding, then those that add or take points.
ANSWERS = ((r"^כן,?\s*יש לי ניסיון", 100), (r"^מכיר(\.?)$|^תיאורטי|^מכיר את התחום ברמה תיאורטית", 40), (r"^אין לי ניסיון בתחום זה", 0), (r"אין לי|no experience|don't have|לא מכיר|לא יודע|never used|אף פעם|לא עבדתי", 5))
THEORY, PRACTICE = r"תיאורטי|theoretical|familiar with|מכיר.*קצת|heard of|שמעתי|קראתי|no hands.on", r"(עבדתי|built|developed|worked|שנה|years)"
ANSWER_POINTS = (
    (r"(עבדתי|worked|developed|built|managed|led|הובלתי|פיתחתי)", 20),
    (r"(שנה|שנתיים|שנים|year|years)", 15),
    (r"(פרויקט|project|production|פרודקשן|live|deployed)", 15),
    (r"(מומחה|expert|advanced|senior|מוביל|lead|architect)", 15),
    (r"(ניסיון|experience|extensive|רב|בכיר)", 10),
    (r"(מאוד|very|highly|deeply|extensively)", 8),
    (r"(קצת|little|basic|בסיסי|beginner|מתחיל)", -15),
    (r"(לא הרבה|not much|limited|מוגבל)", -10),
)


def answer_score(x: Column) -> Column:
    """0 to 100 for a free-text answer; lengths count code points."""
    t = F.lower(stripped(F.coalesce(x, F.lit(""))))
    out = F.when(F.length(t) < 3, 0)
    for pattern, score in ANSWERS:
        out = out.when(t.rlike(pattern), score)
    points = F.lit(15) + F.least(F.lit(20), F.floor(F.length(t) / 9))
    for pattern, n in ANSWER_POINTS:
        points = points + F.when(t.rlike(pattern), n).otherwise(0)
    return out.when(t.rlike(THEORY) & ~t.rlike(PRACTICE), 35).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points))).cast("long")


#: Fixed list of words that say nothing about a posting.
STOP_WORDS = (
    "with", "that", "this", "have", "from", "they", "will", "been", "their", "what", "when", "more", "also", "into", "than", "then", "some", "which",
    "them", "these", "those", "would", "there", "were", "your", "like", "just", "over", "such", "each", "after", "about", "using", "work", "years",
    "team", "skills", "looking", "good", "strong", "plus", "great", "know", "high", "well", "make", "help", "need", "able", "both", "must", "very",
    "only", "much",
)


def keywords(x: Column) -> Column:
    """Distinct words of four ASCII letters or more, in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda w: w.rlike("^[a-z]{4,}$")), F.array(*map(F.lit, STOP_WORDS)))


def passes_prefilter(text: Column, words: Column) -> Column:
    """Whether a text contains two of the words; all texts pass where there are fewer than five words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.size(words) < 5) | (F.size(F.filter(words, lambda w: F.contains(low, w))) >= 2)


def band(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 55, "good").when(score >= 35, "partial").otherwise("weak")
