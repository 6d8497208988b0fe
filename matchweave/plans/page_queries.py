"""Queries of pages: descriptions, cards of list pages made from the pages of the table, sites, repeated readings.

The SQL of the cards reads no markup: it says what must be found from what the lists were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators import page_nodes
from matchweave.plans.inputs import table
from matchweave.plans.registry import query

#: Pages that one list shows, and the addresses of the five kinds of lists.
SHOWN = 15
LISTS = ("https://www.lever.co/list/", "https://jobs.example.com/all/list?page=", "https://work.example.com/q?page=", "https://jobs.example.com/all/list?page=", "https://news.example.com/")


def _plain(html: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), pattern, 1), r"[^\p{L}\p{N}.,-]+", " "))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: lists of SHOWN pages each; of a site, generic cards, repeated items, cards of which some are in a rail, notes."""
    c = F.col
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(c("page_id") / SHOWN).alias("list"), _plain(c("html"), "<h1>([^<]*)").alias("title"), _plain(c("html"), "<p>([^<]+)").alias("said"), F.regexp_extract(F.coalesce("html", F.lit("")), '<html lang="([a-z]*)"', 1).alias("lang"), T.host(c("url")).alias("host"))
    card = lambda around: F.format_string(f'<div class="job-card wide"><h2>%s</h2><span class="company-name">%s</span><p>%s</p><a href="%d?x=1">more</a></div>{around}', "title", "host", "said", "page_id")
    kind = c("list") % 5
    one = (
        F.when(kind == 0, F.format_string('<div class="posting"><a class="posting-title" href="/p/%d"><h5>%s</h5></a><div class="posting-categories"><span class="sort-by-team">%s</span></div><p>%s</div>', "page_id", "title", "lang", "said"))
        .when(kind == 1, card(""))
        .when(kind == 2, F.format_string('<li class="row-x"><a href="https://work.example.com/%d">%s</a><p>%s', "page_id", "title", "said"))
        .when((kind == 3) & (c("page_id") % 2 == 1), F.concat(F.lit('<aside aria-label="People-also viewed">'), card("</aside>")))
        .when(kind == 3, card(""))
        .otherwise(F.format_string('<div class="note">%s</div>', "title"))
    )
    p = p.select("list", F.struct("page_id", one.alias("html")).alias("one"))
    p = p.groupBy("list").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["html"]), "").alias("cards"))
    url = F.concat(F.get(F.array(*map(F.lit, LISTS)), (c("list") % 5).cast("int")), c("list").cast("string"))
    return p.select(c("list").alias("page_id"), url.alias("url"), F.concat(F.lit("<html><head><title>job</title></head><body><nav>job position career</nav><ul>"), "cards", F.lit("</ul></body></html>")).alias("html"))


_SAID = "trim(regexp_replace(regexp_extract(coalesce(html, ''), '{}', 1), '[^\\p{{L}}\\p{{N}}.,-]+', ' ', 'g'))"
_BUTTON = "(?i)^(עדכן|הוסף|חדש|מחק|שמור|בטל|צור|הגש|קרא|פתח|update|add|new|delete|save|cancel|submit|apply|sign|log|register|view|read)"


@query("page_cards", f"""WITH p AS (SELECT page_id AS id, page_id // {SHOWN} AS list, (page_id // {SHOWN}) % 5 AS kind, {_SAID.format("<h1>([^<]*)")} AS t, {_SAID.format("<p>([^<]+)")} AS s,
  regexp_extract(coalesce(html, ''), '<html lang="([a-z]*)"', 1) AS lang, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
w AS (SELECT *, array_to_string(list_filter(CASE kind WHEN 0 THEN [t, lang, s] WHEN 2 THEN [t, s] ELSE [t, host, s, 'more'] END, lambda x: x <> ''), chr(10)) AS body FROM p WHERE kind < 4),
n AS (SELECT *, count(*) OVER l AS n, count(*) FILTER (id % 2 = 0) OVER l AS n_even, count(*) FILTER (len(body) > 60) OVER l AS n_long FROM w WINDOW l AS (PARTITION BY list)),
k AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY id) - 1 AS nth FROM n WHERE CASE kind WHEN 2 THEN n >= 3 AND n_long >= 3 AND len(body) > 60 WHEN 3 THEN n >= 2 AND (n_even < 2 OR id % 2 = 0) ELSE n >= 2 END),
o AS (SELECT list AS page_id, nth::INTEGER AS nth, CASE kind WHEN 0 THEN 'site' WHEN 2 THEN 'repeated' ELSE 'generic' END AS how, CASE kind WHEN 2 THEN body[:80] ELSE t[:100] END AS title, CASE WHEN kind IN (1, 3) THEN host[:60] ELSE '' END AS company,
  CASE kind WHEN 0 THEN lang ELSE '' END AS snippet, CASE kind WHEN 0 THEN 'https://www.lever.co/p/' || id WHEN 2 THEN 'https://work.example.com/' || id ELSE 'https://jobs.example.com/all/' || id || '?x=1' END AS href, body[:800] AS text FROM k WHERE nth < 12)
SELECT * FROM o WHERE len(title) >= 5 AND len(text) >= 15 AND NOT regexp_matches(title, '{_BUTTON}')""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_nodes.cards(lists(spark, sf_dir))


@query("page_descriptions")
def page_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_nodes.descriptions(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_PLATFORM = " ".join(f"WHEN contains(s, '{part}') THEN '{name}'" for part, name in T.PLATFORMS)


@query("page_platforms", f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.' || ['il.linkedin.com', 'boards.greenhouse.io', 'jobs.lever.co', 'Indeed.com'][(page_id // 4) % 4 + 1] || '/x' WHEN 2 THEN replace(url, '.example.com', '.comeet.com') END AS url FROM pages),
h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM u),
s AS (SELECT page_id, CASE WHEN contains(h, 'www.') THEN h[:strpos(h, 'www.') - 1] || h[strpos(h, 'www.') + 4:] ELSE h END AS s FROM h)
SELECT page_id, CASE {_PLATFORM} ELSE s END AS platform FROM s""")
def page_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    made = F.concat(F.lit("https://www."), F.get(F.array(*map(F.lit, ("il.linkedin.com", "boards.greenhouse.io", "jobs.lever.co", "Indeed.com"))), (F.floor(k / 4) % 4).cast("int")), F.lit("/x"))
    url = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, made).when(k % 4 == 2, F.replace("url", F.lit(".example.com"), F.lit(".comeet.com")))
    return table(spark, sf_dir, "pages").select("page_id", T.platform(url).alias("platform"))


@query("page_readings", """WITH t AS (SELECT doc_id AS page_id, coalesce(text, '') AS t, len(coalesce(text, '')) // 3 AS a, CASE doc_id % 3 WHEN 0 THEN 0 ELSE 5 END AS b, CASE doc_id % 2 WHEN 0 THEN 0 ELSE 7 END AS c FROM documents),
r AS (SELECT page_id, least(len(t), a) AS l0, least(len(t), a + b) AS l1, least(len(t), a + b + c) AS l2, t FROM t)
SELECT page_id, CASE WHEN l1 <= l0 THEN t[:l0] WHEN l2 <= l1 THEN t[:l1] ELSE t[:l2] END AS text, CASE WHEN l1 <= l0 THEN 1 WHEN l2 <= l1 THEN 2 ELSE 3 END::BIGINT AS n_read FROM r""")
def page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS page_id", "coalesce(text, '') AS t", "doc_id % 3 > 0 AS b", "doc_id % 2 > 0 AS c")
    sizes = F.floor(F.length("t") / 3) + F.when((F.col("pass") > 0) & F.col("b"), 5).otherwise(0) + F.when((F.col("pass") > 1) & F.col("c"), 7).otherwise(0)
    rows = d.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("pass"))
    return page_nodes.longest_readings(rows.select("page_id", "pass", F.substring(F.col("t"), F.lit(1), sizes.cast("int")).alias("text")))
