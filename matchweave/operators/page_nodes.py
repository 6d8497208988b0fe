"""Pages as nested intervals: elements by selector, descriptions by a cascade of selectors, cards of lists.

``read`` turns a page into one row: its shown text and an array of its elements in document order. An element knows the number of
its last descendant and the stretch of the shown text that it covers, so what is inside an element is a slice of the array, what is
around it an interval that holds its number, and what it shows a substring. All that follows happens within that row by array
functions: nothing is shuffled, and a row is bounded by its page.

Shown text: blocks and line breaks end lines, runs of white space are one space (preformatted ones too), head, scripts, styles and templates show nothing.
Null or empty html has no elements and an empty text. End tags without a beginning are ignored; items, cells, options and
paragraphs end where the next one begins.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions import text as T
from matchweave.operators.community import is_card

#: Selectors of descriptions by site, then of any site, in order.
SITE_DESCRIPTIONS = (
    ("linkedin.com", (".job-view-layout", ".jobs-description", ".scaffold-layout__detail", ".jobs-box__html-content")),
    ("jobmaster.co.il", (".job-description", ".job-content", "#job-description", ".jobDescription")),
    ("alljobs.co.il", (".job-inner-description", ".job-description-text", ".jobContent")),
    ("indeed.com", ("#jobDescriptionText", ".jobsearch-jobDescriptionText", ".job-snippet")),
    ("glassdoor.com", (".jobDescriptionContent", '[class*="JobDescription"]', '[class*="jobDescription"]')),
    ("drushim.co.il", (".job-description", "#job-content", ".position-description")),
    ("gotfriends.co.il", (".job-desc", ".position-description", ".job-content")),
    ("comeet.co", (".position-details", ".job-description", ".position-description")),
    ("hunter.io", (".job-body", ".description-body")),
    ("heyanter.com", (".job-body", ".description-body")),
    ("jobify360.co.il", (".job-description", ".job-content", ".position-description", '[class*="job"]', "article", "main")),
    ("jobs.nvidia.com", (".job-description", ".position-description", '[class*="description"]', "main", "article")),
    ("greenhouse.io", (".job__description", "#content", ".content")),
    ("lever.co", (".section-wrapper", ".posting-content")),
    ("smartrecruiters.com", (".job-description", '[class*="description"]')),
    ("workable.com", (".job-description", '[class*="description"]')),
)
DESCRIPTIONS = (
    'article[class*="job"]', 'main[class*="job"]', '[class*="job-description"]', '[class*="jobDescription"]', '[id*="job-description"]', '[id*="jobDescription"]',
    '[class*="position-description"]', '[class*="vacancy-description"]', '[class*="job-details"]', '[class*="jobDetails"]', "article", "main",
    '[class*="description"]', '[class*="content"]', "#content", ".content",
)
#: Selectors of cards, their titles, companies and snippets by site; of cards of any site, in order.
SITE_CARDS = (
    ("linkedin.com", ".jobs-search-results__list-item, .job-card-container--clickable", ".job-card-list__title--link strong, .job-card-container__link strong, .job-card-list__title", ".job-card-container__primary-description, .artdeco-entity-lockup__subtitle span", ".job-card-list__footer-wrapper"),
    ("indeed.com", ".job_seen_beacon, .resultContent", ".jobTitle span[title], .jobTitle a span", ".companyName", ".job-snippet"),
    ("glassdoor.com", '[class*="JobCard_jobCard"], [data-test="jobListing"]', '[class*="JobCard_jobTitle"], [data-test="job-title"]', '[class*="EmployerProfile_employerName"], [data-test="employer-short-name"]', '[class*="JobCard_location"]'),
    ("jobs.nvidia.com", '[class*="position"], tr[class*="job"], [data-ph-at-id]', 'h3 a, [class*="title"] a, a[class*="job"]', "", '[class*="location"], [class*="department"]'),
    ("greenhouse.io", ".opening", ".opening a", "", ".location"),
    ("lever.co", ".posting", ".posting-title h5", "", ".posting-categories .sort-by-team"),
    ("jobmaster.co.il", '[class*="job-item"], [class*="jobItem"], li[class*="job"]', '[class*="job-title"], h2 a, h3 a', '[class*="company"]', '[class*="snippet"]'),
    ("alljobs.co.il", '.job-item, [class*="job-box"]', ".job-title a, h2 a", ".company-name", ".job-description-short"),
    ("drushim.co.il", '[class*="job-item"], .job-box', ".job-title, h3 a", ".company-name", ".job-brief"),
)
CARDS = (
    '[class*="job-card"]', '[class*="jobCard"]', '[class*="job-listing"]', '[class*="job-item"]', '[class*="jobItem"]', '[class*="job-result"]', '[class*="position-item"]', '[class*="vacancy-item"]', '[class*="vacancy-card"]',
    '[class*="opening-item"]', '[class*="opening"]', "[data-job-id]", "[data-jobid]", "[data-position-id]", 'li[class*="position"]', 'li[class*="job"]', 'article[class*="job"]', 'article[class*="position"]',
    "tr.job", 'tr[class*="job"]', 'tr[class*="position"]', ".posting", '[class*="posting-item"]', '[class*="result-card"]', '[class*="resultCard"]',
)
REPEATED = ("li", "article", 'div[class*="card"]', 'div[class*="item"]', 'div[class*="result"]', 'div[class*="listing"]')
TITLE, COMPANY = 'h2, h3, h4, a[class*="title"], [class*="title"] a', '[class*="company"], [class*="employer"]'
RAILS = r"(?i)similar|related|recommend|also-?viewed|also_viewed|people-?also|more-?jobs|other-?jobs|suggest|carousel|נוספות|דומות|מומלצות"

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_UNSHOWN = set("head script style noscript template title textarea iframe".split())
_RAW = set("script style title textarea iframe".split())
_BLOCK = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tr ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HELD = set("ul ol dl table select body html".split())

_NODE = pa.struct([("node", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("size", pa.int32())])
_SCHEMA = "page_id long, url string, text string, nodes array<struct<node: int, last: int, tag: string, attrs: map<string, string>, start: int, size: int>>"


def _elements(page: str) -> tuple[str, list[dict]]:
    """The shown text and the elements of a page, read once from left to right."""
    nodes, open_, shown, size, unshown, at = [], [], [], 0, 0, 0

    def show(s: str) -> None:
        nonlocal size
        if unshown or not s:
            return
        s = re.sub(r"\s+", " ", entities.unescape(s))
        if not shown or shown[-1][-1] in " \n":
            s = s.lstrip(" ")
        if s:
            shown.append(s)
            size += len(s)

    def line() -> None:
        nonlocal size
        if not unshown and shown and shown[-1] != "\n":
            shown.append("\n")
            size += 1

    def close(k: int) -> None:
        nonlocal unshown
        for n in reversed(open_[k:]):
            unshown -= n["tag"] in _UNSHOWN
            n["last"], n["size"] = len(nodes) - 1, size - n["start"]
            if n["tag"] in _BLOCK:
                line()
        del open_[k:]

    def innermost(tags: set[str], held: set[str]) -> int | None:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k]["tag"] in tags:
                return k
            if open_[k]["tag"] in held:
                return None
        return None

    while at < len(page):
        m = _TOKEN.search(page, at)
        show(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = innermost({tag}, set())
            if k is not None:
                close(k)
            continue
        ended = _ENDS.get(tag, {"p"} if tag in _BLOCK else set())
        k = innermost(ended, _HELD - {tag}) if ended else None
        if k is not None:
            close(k)
        if tag == "br":
            line()
        if tag in _BLOCK:
            line()
        attrs: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            attrs.setdefault(a[1].lower(), entities.unescape(a[2] or a[3] or a[4] or ""))
        n = {"node": len(nodes), "last": len(nodes), "tag": tag, "attrs": list(attrs.items()), "start": size, "size": 0}
        nodes.append(n)
        if tag in _VOID:
            continue
        open_.append(n)
        unshown += tag in _UNSHOWN
        if tag in _RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(open_) - 1)
    close(0)
    return "".join(shown), nodes


def read(pages: DataFrame) -> DataFrame:
    """page_id, url, text, nodes of pages (page_id, url, html)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("nodes", pa.list_(_NODE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            text, nodes = zip(*(_elements(x or "") for x in batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(nodes, pa.list_(_NODE))], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _SCHEMA)


# Selectors

_STEP = "struct<tag: string, name: string, op: string, value: string>"
_SELECTOR = f"array<struct<own: {_STEP}, around: {_STEP}>>"


def _step(s: str) -> dict[str, str]:
    tag, mark, name, op, value = re.fullmatch(r"""([a-z0-9]*)(?:([.#])([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\])?""", s).group(1, 2, 3, 5, 6)
    if mark:
        return {"tag": tag, "name": "class" if mark == "." else "id", "op": "word" if mark == "." else "=", "value": name}
    named = re.search(r"\[([\w-]+)", s)
    return {"tag": tag, "name": named[1] if named else "", "op": op or ("given" if named else ""), "value": value or ""}


def selector(s: str) -> list[dict]:
    """A selector as data: alternatives of a tag with at most one condition (.word, #id, [name], [name="v"], [name*="v"]), each
    perhaps inside one other. It is matched by ``matches``."""
    out = []
    for way in filter(None, (x.strip() for x in s.split(","))):
        *around, own = way.split()
        out.append({"own": _step(own), "around": _step(around[0]) if around else None})
    return out


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def _fits(n: Column, s: Column) -> Column:
    got = n["attrs"][s["name"]]
    words = F.concat(F.lit(" "), F.regexp_replace(got, r"\s+", " "), F.lit(" "))
    by = (
        F.when(s["op"] == "", True)
        .when(got.isNull(), False)
        .when(s["op"] == "given", True)
        .when(s["op"] == "=", got == s["value"])
        .when(s["op"] == "*=", got.contains(s["value"]))
        .otherwise(words.contains(F.concat(F.lit(" "), s["value"], F.lit(" "))))
    )
    return ((s["tag"] == "") | (n["tag"] == s["tag"])) & by


def matches(n: Column, ways: Column, nodes: Column) -> Column:
    """Whether an element fits one of a selector's alternatives; elements around it are looked for only where it fits itself."""
    around = lambda way: F.exists(nodes, lambda r: (r["node"] < n["node"]) & (r["last"] >= n["node"]) & _fits(r, way["around"]))
    return F.coalesce(F.exists(ways, lambda way: _fits(n, way["own"]) & (way["around"].isNull() | around(way))), F.lit(False))


def shown(text: Column, n: Column) -> Column:
    return F.substring(text, n["start"] + 1, n["size"])


def inside(nodes: Column, n: Column) -> Column:
    """The elements inside an element."""
    return F.slice(nodes, n["node"] + 2, n["last"] - n["node"])


def _by_site(url: Column, rows: list[tuple[str, object]], kind: str) -> Column:
    """The value of the first site whose name the host contains; null without one."""
    host, out = T.site(url), F
    for name, value in rows:
        out = out.when(host.contains(name), _literal(value, kind))
    return out


def descriptions(pages: DataFrame) -> DataFrame:
    """page_id, found (site, generic or body), text: the first element of the site's selectors, in their order, that shows more than
    100 characters (of a selector only its first element counts), else the first of the generic ones with more than 200, else the
    whole page. Texts are cleaned and have no cap."""
    kind = f"array<{_SELECTOR}>"
    rows = read(pages).withColumn("own", _by_site(F.col("url"), [(name, [selector(s) for s in found]) for name, found in SITE_DESCRIPTIONS], kind))
    nodes, text = F.col("nodes"), F.col("text")
    none = F.lit(None).cast("string")
    trimmed = lambda n: T.stripped(shown(text, n))

    def site(acc: Column, ways: Column) -> Column:
        first = F.get(F.filter(nodes, lambda n: matches(n, ways, nodes)), F.lit(0))
        return F.when(acc.isNotNull(), acc).when(F.length(trimmed(first)) > 100, shown(text, first))

    def generic(acc: Column, ways: Column) -> Column:
        long = F.filter(nodes, lambda n: matches(n, ways, nodes) & (F.length(trimmed(n)) > 200))
        return F.when(acc.isNotNull(), acc).otherwise(shown(text, F.get(long, F.lit(0))))

    rows = rows.withColumn("by_site", F.aggregate(F.coalesce("own", F.array().cast(kind)), none, site))
    rows = rows.withColumn("by_any", F.when(F.col("by_site").isNull(), F.aggregate(_literal([selector(s) for s in DESCRIPTIONS], kind), none, generic)))
    found = F.when(F.col("by_site").isNotNull(), "site").when(F.col("by_any").isNotNull(), "generic").otherwise("body")
    return rows.select("page_id", found.alias("found"), T.cleaned(F.coalesce("by_site", "by_any", "text")).alias("text"))


def longest_readings(readings: DataFrame) -> DataFrame:
    """page_id, text, n_read: of the readings (page_id, pass, text) of a page, numbered from 0, the last before one that isn't longer
    than that before it; at most two passes after the first count."""
    before = Window.partitionBy("page_id").orderBy("pass")
    longer = F.length(F.coalesce("text", F.lit(""))) > F.lag(F.length(F.coalesce("text", F.lit("")))).over(before)
    rows = readings.where("pass <= 2").withColumn("stopped", F.when(F.col("pass") == 0, False).otherwise(~longer))
    rows = rows.withColumn("stopped", F.max("stopped").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("NOT stopped").groupBy("page_id").agg(F.max_by("text", "pass").alias("text"), F.count("*").alias("n_read"))


# Cards


def _repeated(nodes: Column, text: Column) -> Column:
    """The elements of the first group of 3 to 150 elements of the same tag and class of which three show more than 60 characters
    and hold a link: those that do. An element that fits two selectors counts twice, as two finds."""

    def found(rank: int, ways: Column) -> Column:
        key = lambda n: F.concat(F.upper(n["tag"]), F.lit("|"), F.coalesce(n["attrs"]["class"], F.lit("")))
        return F.transform(F.filter(nodes, lambda n: matches(n, ways, nodes)), lambda n: F.struct(key(n).alias("key"), F.lit(rank).alias("rank"), n["node"].alias("node")))

    finds = F.concat(*[found(k, _literal(selector(s), _SELECTOR)) for k, s in enumerate(REPEATED)])
    finds = F.array_sort(F.filter(finds, lambda f: F.length(f["key"]) >= 5))

    def groups(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["key"] != F.get(s, i - 2)["key"]))
        return F.transform(starts, lambda i, j: F.slice(s, i, F.coalesce(F.get(starts, j + 1), F.size(s) + 1) - i))

    def full(f: Column) -> Column:
        n = F.get(nodes, f["node"])
        return (F.length(T.stripped(shown(text, n))) > 60) & F.exists(inside(nodes, n), lambda x: x["tag"] == "a")

    # a one-element array binds the sorted finds once
    parts = F.flatten(F.transform(F.array(finds), lambda s: F.when(F.size(s) > 0, groups(s)).otherwise(F.slice(F.array(s), 1, 0))))
    parts = F.filter(parts, lambda g: F.size(g).between(3, 150))
    parts = F.filter(F.transform(parts, lambda g: F.struct(F.get(g, F.lit(0))["rank"].alias("rank"), F.get(g, F.lit(0))["node"].alias("node"), F.filter(g, full).alias("of"))), lambda g: F.size(g["of"]) >= 3)
    first = F.array_min(F.transform(parts, lambda g: F.struct(g["rank"], g["node"], F.transform(g["of"], lambda f: f["node"]).alias("of"))))
    return F.transform(F.coalesce(first["of"], F.array().cast("array<int>")), lambda i: F.get(nodes, i))


def _href(url: Column, href: Column) -> Column:
    """An address as seen from a page: whole, without scheme, from the root, a query, a mark, or from the page's folder."""
    bare = F.regexp_extract(url, r"^[^?#]*", 0)
    root = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*", 0)
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(bare, r"^.*/", 0))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^[a-zA-Z]+:", 0), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_extract(url, r"^[^#]*", 0), href))
        .otherwise(F.concat(folder, href))
    )


def cards(pages: DataFrame, most: int = 12) -> DataFrame:
    """page_id, nth, how, title, company, snippet, href, text: the cards of list pages.

    Cards come from the site's selectors, else from the first generic selector that gives two, else, on pages that speak of work,
    from repeated containers with links. Cards in rails of similar offers go, unless fewer than two would be left. The first
    ``most`` are read: title 100 characters, company 60, snippet 150, text 800; those whose title is short or a button, or that
    show fewer than 15 characters, go, and ``nth`` keeps the number that a card had before."""
    site = "struct<cards: {0}, title: {0}, company: {0}, snippet: {0}>".format(_SELECTOR)
    named = [(name, dict(zip(("cards", "title", "company", "snippet"), map(selector, found), strict=True))) for name, *found in SITE_CARDS]
    rows = read(pages).withColumn("site", _by_site(F.col("url"), named, site))
    nodes, text = F.col("nodes"), F.col("text")
    sign = lambda n: F.concat_ws(" ", *[F.coalesce(n["attrs"][a], F.lit("")) for a in ("class", "id", "aria-label", "data-test")])
    rows = rows.withColumn("rails", F.filter(nodes, lambda n: ~n["tag"].isin("body", "html") & sign(n).rlike(RAILS)))
    none = F.slice(nodes, 1, 0)

    def kept(found: Column) -> Column:
        """Without rails, if two are left; nothing if there aren't two at all. One-element arrays bind what is used twice."""
        out = F.transform(F.array(found), lambda c: F.struct(c.alias("all"), F.filter(c, lambda n: ~F.exists(F.col("rails"), lambda r: (r["node"] <= n["node"]) & (n["node"] <= r["last"]))).alias("own")))
        out = F.transform(out, lambda c: F.when(F.size(c["own"]) >= 2, c["own"]).when(F.size(c["all"]) >= 2, c["all"]).otherwise(none))
        return F.get(out, F.lit(0))

    def step(acc: Column, ways: Column) -> Column:
        return F.when(F.size(acc) >= 2, acc).otherwise(kept(F.filter(nodes, lambda n: matches(n, ways, nodes))))

    rows = rows.withColumn("by_site", kept(F.filter(nodes, lambda n: matches(n, F.col("site.cards"), nodes))))
    rows = rows.withColumn("by_any", F.when(F.size("by_site") < 2, F.aggregate(_literal([selector(s) for s in CARDS], f"array<{_SELECTOR}>"), none, step)).otherwise(none))
    rows = rows.withColumn("repeated", F.when((F.size("by_site") < 2) & (F.size("by_any") < 2) & T.has_page_words(text), kept(_repeated(nodes, text))).otherwise(none))
    how = F.when(F.size("by_site") >= 2, "site").when(F.size("by_any") >= 2, "generic").otherwise("repeated")
    rows = rows.select("page_id", "url", "text", "nodes", "site", how.alias("how"), F.posexplode(F.slice(F.concat("by_site", "by_any", "repeated"), 1, most)).alias("nth", "card"))
    rows = rows.withColumns({"of": inside(nodes, F.col("card")), "site": F.when(F.col("how") == "site", F.col("site"))})

    def part(ways: Column) -> Column:
        """What the first fitting element inside the card shows; null without one."""
        return T.stripped(shown(text, F.get(F.filter("of", lambda n: matches(n, ways, nodes)), F.lit(0))))

    card = shown(text, F.col("card"))
    given = lambda c: F.when(c != "", c)
    title = F.coalesce(given(part(F.col("site.title"))), part(_literal(selector(TITLE), _SELECTOR)), F.substring(T.stripped(card), 1, 80))
    company = F.coalesce(given(part(F.col("site.company"))), part(_literal(selector(COMPANY), _SELECTOR)), F.lit(""))
    href = F.get(F.filter("of", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull()), F.lit(0))["attrs"]["href"]
    out = rows.select(
        "page_id", "nth", "how", F.substring(title, 1, 100).alias("title"), F.substring(company, 1, 60).alias("company"), F.substring(F.coalesce(part(F.col("site.snippet")), F.lit("")), 1, 150).alias("snippet"),
        F.coalesce(_href(F.col("url"), href), F.lit("")).alias("href"), F.substring(T.cleaned(card), 1, 800).alias("text"),
    )
    return out.where(is_card(F.col("title"), F.col("text")))
