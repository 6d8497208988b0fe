"""Main text of web pages by consensus host paths.

1. Every page is scanned into containers and blocks of text. A container's score is the length of the text below it that
   is neither boilerplate nor mostly links; the page's best container is the deepest that holds most of it.
2. Each page votes for its best container's path: tags and classes from the root, digits generalised. Votes are counted
   per host and path in Spark, with partial sums before the shuffle, so a host of a third of all pages is no burden.
3. Each page is read again with its host's winning path. Where that path is missing, or holds far less text than the
   page's own best container, the latter is used. Where it lies inside the page's own container, that one's other unlinked
   blocks stay too; unless the winner is (in) an article or main, so do unlinked paragraphs, headings, quotes, list items
   and cells outside it. What goes beside a winner is boilerplate, blocks of links, and bare text of other containers.

Blocks are what block-level elements hold. Inside a block, character references are decoded and runs of white space
become one space; ``<br>`` is white space. Boilerplate: nav, header (outside an article), footer, aside, form, script,
style and the like, hidden elements, and elements whose class, id or role names a menu, advert, notice, sidebar, comment
and so on.

Defined cases: null or empty html gives an empty text; html without tags is one block; a page that is all boilerplate
gives what it holds outside scripts and menus, by tag alone. A null or odd url has the host "". Repeated rows give a row
each. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: A container is preferred to those around it if it holds this share of the page's text.
MOST = 0.7
#: The host's path is not used on a page where it holds less than this share of the own best container's text.
LEAST = 0.25

_TAG = re.compile(
    r"""<!--.*?-->|<!--.*|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S
)
_OPEN_END = re.compile(r"<[/a-zA-Z!?][^>]*\Z", re.S)
_ATTR = re.compile(r"""(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_RAW_END = {t: re.compile(f"</{t}[^>]*>", re.I) for t in _RAW}
_CONTAINERS = {"article", "main", "section", "div", "td", "body", "center", "blockquote"}
_BLOCKS = _CONTAINERS | set(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre table thead tbody tfoot tr th caption figure figcaption address details summary"
    " fieldset legend nav header footer aside form dialog menu search noscript template svg object select option button label canvas video audio hgroup".split()
)
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_DROPPED = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "search", "noscript", "template", "svg", "object", "select", "button", "canvas", "video", "audio"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Fixed word list: what class, id or role of boilerplate is called.
_NEGATIVE = set(
    "ad ads advert advertisement adverts advertising adsense alert alertdialog banner breadcrumb breadcrumbs byline-share comment comments commentlist"
    " complementary consent contentinfo cookie cookies dialog disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notices notification notifications pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar"
    " sidenav signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Of those, the words that count on article and main elements.
_NEGATIVE_ARTICLE = set("ad ads advert advertisement comment comments commentlist promo recommended related replies reply sponsored".split())
#: Elements whose unlinked text stays wherever it stands, on pages without an article or main element around the winner.
_ORDINARY = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption".split())
_TITLED = {"article", "post", "entry", "story", "content"}
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Containers (node 0 is the page) and blocks of a page, in page order."""

    path: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    article: list[bool] = field(default_factory=lambda: [False])
    #: (container, text, share of the text in links, boilerplate by tag, boilerplate by name, the element's tag)
    blocks: list[tuple[int, str, float, bool, bool, str]] = field(default_factory=list)


def _named(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """Generalised step of the path, boilerplate by name, hidden."""
    if not attrs or attrs.isspace():
        return tag, False, False
    step, negative, hidden = tag, False, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            step = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in value.split()})])
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
            continue
        elif name == "hidden":
            hidden |= m.start() == 0 or attrs[m.start() - 1].isspace()
            continue
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
            continue
        words = {w.lower() for w in _WORDS.findall(value)}
        hit = words & (_NEGATIVE_ARTICLE if tag in ("article", "main") else _NEGATIVE)
        negative |= bool(hit - {"header"}) or ("header" in hit and not words & _TITLED)
    return step, negative and tag not in ("html", "body"), hidden and tag not in ("html", "body")


def scan(text: str) -> Page:
    page = Page()
    # each open element: tag, container, dropped by tag, dropped by name, inside an article
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    parts: list[str] = []
    in_link = linked = pos = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            line = " ".join("".join(parts).split())
            if line:
                tag, at, by_tag, by_name, _ = stack[-1]
                page.blocks.append((at, line, min(1.0, linked / len(line)), by_tag, by_name, tag))
            parts.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal linked
        if s:
            s = _html.unescape(s) if "&" in s else s
            parts.append(s)
            if in_link:
                linked += len(s.strip())

    def close(k: int) -> None:
        flush()
        del stack[k:]

    end = _OPEN_END.search(text, max(0, text.rfind("<")))
    text = text[: end.start()] if end else text
    while True:
        m = _TAG.search(text, pos)
        if m is None:
            break
        say(text[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in _RAW and not closing:
            m = _RAW_END[tag].search(text, pos)
            pos = m.end() if m else len(text)
        elif tag not in _BLOCKS or tag in _VOID:
            continue
        elif closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                flush()
            in_link = 0
        else:
            if stack[-1][0] == "p" or stack[-1][0] in _CLOSED_BY.get(tag, ()):
                close(len(stack) - 1)
            elif tag in ("li", "tr", "td", "th", "dt", "dd"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _CLOSED_BY[tag]:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "table", "tbody", "thead", "dl") or tag in ("td", "th") and stack[k][0] == "tr":
                        break
            flush()
            in_link = 0
            _, at, by_tag, by_name, inside = stack[-1]
            step, negative, hidden = _named(tag, attrs)
            by_tag |= tag in _DROPPED or hidden or (tag == "header" and not inside)
            by_name |= negative
            inside |= tag == "article"
            if tag in _CONTAINERS and tag != "body":
                page.path.append(f"{page.path[at]}>{step}")
                page.parent.append(at)
                page.article.append(tag in ("article", "main"))
                at = len(page.path) - 1
            stack.append((tag, at, by_tag, by_name, inside))
    say(text[pos:])
    flush()
    return page


def _kept(page: Page) -> list[tuple[int, str, float, str]]:
    """The blocks that are no boilerplate, by tag or by name; a page of nothing else has none."""
    return [(at, t, link, tag) for at, t, link, by_tag, by_name, tag in page.blocks if not by_tag and not by_name]


def _scores(page: Page, kept: list[tuple[int, str, float, str]]) -> list[float]:
    score = [0.0] * len(page.path)
    for at, text, link, _ in kept:
        if link < 0.5:
            score[at] += len(text) * (1 - link)
    for k in range(len(score) - 1, 0, -1):
        score[page.parent[k]] += score[k]
    return score


def best_container(page: Page, score: list[float]) -> int:
    """The deepest container with MOST of the page's score, or the article or main element around it."""
    at = 0
    for k in range(1, len(score)):
        if page.parent[k] == at and score[k] >= MOST * score[0] > 0:
            at = k
    k = at
    while k > 0:
        if page.article[k]:
            return k
        k = page.parent[k]
    return at


def _below(page: Page, tops: set[int]) -> list[bool]:
    inside = [k in tops for k in range(len(page.path))]
    for k in range(1, len(inside)):
        inside[k] |= inside[page.parent[k]]
    return inside


def _above(page: Page, tops: set[int]) -> set[int]:
    """The containers and those around them."""
    out = set()
    for k in tops:
        while k >= 0:
            out.add(k)
            k = page.parent[k]
    return out


def extract(text: str, host_path: str | None) -> str:
    page = scan(text)
    kept = _kept(page)
    score = _scores(page, kept)
    own = best_container(page, score)
    tops = {own}
    if host_path is not None and page.path[own] != host_path:
        found = {k for k, p in enumerate(page.path) if p == host_path}
        if found and sum(score[k] for k in found) >= LEAST * score[own]:
            tops = found
    inside = _below(page, tops)
    wide = _below(page, {own}) if tops != {own} else inside
    around = any(inside[k] and not wide[k] for k in tops)
    article = any(page.article[k] for k in _above(page, tops))

    def stays(at: int, link: float, tag: str) -> bool:
        return inside[at] or link < 0.5 and (wide[at] and not around or tag in _ORDINARY and not article)

    return "\n".join(t for at, t, link, tag in kept if stays(at, link, tag))


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that most pages of the host vote for (ties: more text, then the first path)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, chars = [], []
            for h in batch.column(1).to_pylist():
                page = scan(h or "")
                score = _scores(page, _kept(page))
                at = best_container(page, score)
                paths.append(page.path[at])
                chars.append(int(score[at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(chars, pa.int64())], names=["host", "path", "chars"])

    votes = pages.select(host_of("url").alias("host"), F.col("html").cast("string").alias("html")).where("html is not null").mapInArrow(vote, "host string, path string, chars long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), -F.col("chars"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    The table of host paths is written first. Spark reads its size from the files and broadcasts it only if it is small;
    otherwise pages and paths meet in a sort-merge join, whose large partitions adaptive execution splits.
    """
    paths = saved(host_paths(pages)).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    joined = rows.join(paths, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "__path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
