"""Tracked links in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: links already marked; then marked-up, raw and bare ones.
MARKED = r"\[LINK:([^|]*)\|([^\]]+)\]"
LOOSE = (
    r"(?U)\[([^\]]+)\]\((https?://[^)]+)\)|(https?://[^\s)\]\"'>]+)"
    r"|(?<![/\w@.])([a-zA-Z0-9][a-zA-Z0-9-]{2,}\.(?:com|io|dev|me|net|org|co|ai|app|tech)/[^\s)\]\"'>]+)"
)
_LINK, _PART, _SPLIT = "\x01", "\x02", "\x03"


def _unpointed(x: Column) -> Column:
    return F.regexp_replace(x, r"[.,;:!?]+$", "")


def _made(url: Column, shown: Column, app_id: Column, base: str) -> Column:
    url = _unpointed(url)
    full = F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("https://"), url))
    target = F.when(F.contains(full, F.lit("github.com")), "github").when(F.contains(full, F.lit("linkedin.com")), "linkedin").otherwise("portfolio")
    encoded = F.url_encode(full)
    for mark, code in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(mark), F.lit(code))
    return F.concat(F.lit("[LINK:"), _unpointed(shown), F.lit(f"|{base}?app_id="), app_id.cast("string"), F.lit("&target="), target, F.lit("&url="), encoded, F.lit("]"))


def tracked(text: Column, app_id: Column, base: str) -> Column:
    """``text`` with every link as ``[LINK:shown|base?app_id=..&target=..&url=..]``: those already marked, marked-up ones, raw
    and bare addresses. Marked links are taken out first, so an address beside one ends there. Marks of end punctuation are
    dropped from addresses; the control characters 1 to 3 are dropped from the text. Null stays null."""

    def pieces(x: Column, mark: str, plain, link) -> Column:
        return F.array_join(F.transform(F.split(x, mark), lambda s, i: F.when(i % 2 == 0, plain(s)).otherwise(link(s))), "")

    def half(s: Column, n: int) -> Column:
        return F.split_part(s, F.lit(_SPLIT), F.lit(n))

    def marked(s: Column) -> Column:
        url, shown = half(s, 2), half(s, 1)
        return _made(url, F.when(shown == "", url).otherwise(shown), app_id, base)

    def loose(s: Column) -> Column:
        url, shown = half(s, 2), half(s, 1)
        bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/+$", "")
        return _made(url, F.when(shown == "", bare).otherwise(shown), app_id, base)

    def rest(s: Column) -> Column:
        return pieces(F.regexp_replace(s, LOOSE, f"{_PART}$1{_SPLIT}$2$3$4{_PART}"), _PART, lambda x: x, loose)

    clean = F.translate(text, _LINK + _PART + _SPLIT, "")
    return pieces(F.regexp_replace(clean, MARKED, f"{_LINK}$1{_SPLIT}$2{_LINK}"), _LINK, rest, marked)
