"""Structured text documents: marked sections, role and bullet units, page fit, revision tables, block ranges."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.text import stripped
from matchweave.streaming import parsers

BULLET = r"^\s*[-•*·▪‣–]\s+"
HEADER = r" \| |\b(19|20)\d{2}\b"
WORD_BUDGET = {False: 620, True: 550}
WORDS_A_ROLE = 2
OVERFLOW = 0.15


def section_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, section, line: lines under the last ``[SECTION]`` mark; those before any are under PROFILE."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    mark = F.nullif(F.regexp_extract(stripped(F.col("line")), r"^\[([A-Z ]+)\]$", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("mark", mark).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("PROFILE")))
    return rows.where(F.col("mark").isNull() & (stripped(F.col("line")) != "")).select("doc_id", "line_no", "section", "line")


def units(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, kind (bullet or role), role_index, text of the lines of one section.

    A header starts a role; a free line does so only after a bullet or at the start, else it belongs to the header before it."""
    t = stripped(F.col("line"))
    kind = F.when(F.col("line").rlike(BULLET), "bullet").when(t.rlike(HEADER), "header").otherwise("free")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    starts = (F.col("kind") == "header") | ((F.col("kind") == "free") & F.coalesce(F.col("before") == "bullet", F.lit(True)))
    rows = rows.withColumn("starts", starts).withColumn("unit", F.sum(F.when(F.col("starts") | (F.col("kind") == "bullet"), 1).otherwise(0)).over(w))
    rows = rows.withColumn("role_index", F.sum(F.col("starts").cast("int")).over(w) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("line", BULLET, "").alias("line")))), lambda x: stripped(x["line"])), " ")
    first_bullet = F.min(F.when(F.col("unit") == 1, F.col("kind") == "bullet")).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("role_index", F.col("role_index") + F.coalesce(first_bullet, F.lit(False)).cast("int"))
    made = rows.groupBy("doc_id", "unit").agg(F.min("line_no").alias("line_no"), F.when(F.max(F.col("kind") == "bullet"), "bullet").otherwise("role").alias("kind"), F.max("role_index").alias("role_index"), text.alias("text"))
    return made.select("doc_id", "line_no", "kind", F.col("role_index").cast("long").alias("role_index"), "text")


def page_fit(docs: DataFrame, hebrew: bool = False) -> DataFrame:
    """doc_id, words, roles, ratio (above the budget, rounded half to even), overflows."""
    text = F.regexp_replace(F.col("text"), r"(?m)^\s*\[[A-Z ]+\]\s*$", "")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    roles = F.size(F.filter(F.split("text", "\r?\n"), lambda x: x.rlike(HEADER) & ~x.rlike(BULLET)))
    budget = WORD_BUDGET[hebrew]
    ratio = (F.col("words") + F.col("roles") * WORDS_A_ROLE) / F.lit(float(budget)) - 1
    return docs.select("doc_id", words.alias("words"), roles.alias("roles")).select("doc_id", F.col("words").cast("long").alias("words"), F.col("roles").cast("long").alias("roles"), F.bround(ratio, 3).alias("ratio"), (ratio > OVERFLOW).alias("overflows"))


def revisions(new: DataFrame, old: DataFrame, floor: float = 0.35, same: float = 0.97) -> DataFrame:
    """doc_id, line_no, text, best, ratio, changed: for each new unit, the most similar old line of its document (ratio of
    matching blocks; the first of equals; none below ``floor``).

    Both sides meet per document, and a document's lines are bounded by its text, so candidates travel as one array."""
    lines = old.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("candidates"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best, ratios = [], []
            for text, candidates in zip(frame["text"], frame["candidates"], strict=True):
                top, at = floor, None
                matcher = difflib.SequenceMatcher()
                matcher.set_seq2(text.lower())
                for c in candidates if candidates is not None else ():
                    matcher.set_seq1(c.lower())
                    if matcher.real_quick_ratio() > top or at is None:
                        r = matcher.ratio()
                        if r > top or (at is None and r >= top):
                            top, at = r, c
                best.append(at)
                ratios.append(round(top, 6) if at is not None else None)
            out = frame[["doc_id", "line_no", "text"]].copy()
            out["best"], out["ratio"] = best, ratios
            out["changed"] = [r is None or r < same for r in ratios]
            yield out

    return new.join(lines, "doc_id", "left").select("doc_id", "line_no", "text", "candidates").mapInPandas(run, "doc_id long, line_no int, text string, best string, ratio double, changed boolean")


def edit_script(a: list[str], b: list[str], most: int = 40_000) -> list[tuple[str, str]]:
    """Operations (keep, delete, insert) that turn ``a`` into ``b`` by a longest common subsequence; insertions go last to
    first on ties. Beyond ``most`` cells all is deleted and inserted."""
    n, m = len(a), len(b)
    if n * m > most:
        return [("delete", x) for x in a] + [("insert", x) for x in b]
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    out, i, j = [], n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("keep", a[i]))
        elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
            j -= 1
            out.append(("insert", b[j]))
        else:
            i -= 1
            out.append(("delete", a[i]))
    return out[::-1]


def line_diffs(pairs: DataFrame) -> DataFrame:
    """doc_id, kept, deleted, inserted, in_blocks: line changes from ``old`` to ``new``; shown as two blocks if over 3 / 4 of
    the lines change and there are more than two old ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, old, new in zip(frame["doc_id"], frame["old"], frame["new"], strict=True):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                kinds = [k for k, _ in edit_script(a, b)]
                kept, gone, come = (kinds.count(k) for k in ("keep", "delete", "insert"))
                rows.append((doc_id, kept, gone, come, len(a) > 2 and (gone + come) / max(1, len(kinds)) > 0.75))
            yield pd.DataFrame(rows, columns=["doc_id", "kept", "deleted", "inserted", "in_blocks"])

    return pairs.select("doc_id", "old", "new").mapInPandas(run, "doc_id long, kept long, deleted long, inserted long, in_blocks boolean")


def clamped_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, block, first, last: a block ends at the latest one line before the next begins."""
    after = F.lead("first").over(Window.partitionBy("doc_id").orderBy("first", "block", "last"))
    return blocks.select("doc_id", "block", "first", F.greatest("first", F.least("last", F.coalesce(after - 1, F.col("last")))).alias("last"))


def rescaled_weights(rows: DataFrame, total: int) -> DataFrame:
    """group_id, seq, weight: weights scaled to ``total`` in whole numbers (half to even); the last one takes what remains."""
    whole = Window.partitionBy("group_id")
    w = whole.orderBy("seq", "weight")
    share = F.bround(F.col("weight") * total / F.sum("weight").over(whole)).cast("long")
    rows = rows.withColumn("share", share).withColumn("rest", total - F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.lead("seq").over(w).isNull()
    return rows.select("group_id", "seq", F.when(last, F.coalesce("rest", F.lit(total))).otherwise(F.col("share")).cast("long").alias("weight"))


def strategy(outputs: DataFrame) -> DataFrame:
    """doc_id, prose, fit_type, n_questions from model output: prose, the mark ###STRATEGY###, JSON; by ``parsers.strategies``."""
    prose = stripped(F.split_part("text", F.lit(parsers.STRATEGY), F.lit(1)))
    return parsers.strategies(outputs.select("doc_id", prose.alias("prose"), F.col("text").alias("private")))


def reassembled(units: DataFrame) -> DataFrame:
    """doc_id, text, n_units of documents put together again from their units (doc_id, unit_order, unit_id, unit_type, changed, approved,
    original_text, updated_text): a change that was rejected (``approved`` is false; null counts as approved) gives its original back
    if that has more than two characters. Ties of the order go by id. Bullets are marked, headers but the first stand after an empty line, units without text
    are left out; a document of which nothing is left is empty."""
    said = stripped(F.coalesce("updated_text", F.lit("")))
    was = stripped(F.coalesce("original_text", F.lit("")))
    rejected = ~F.coalesce("approved", F.lit(True)) & F.coalesce("changed", F.lit(False)) & (F.length(was) > 2)
    rows = units.withColumn("line", F.when(rejected, was).otherwise(said))
    header = (F.col("unit_type") == "role_header") & (F.col("line") != "")
    before = Window.partitionBy("doc_id").orderBy("unit_order", "unit_id").rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.max(header).over(before), F.lit(False))
    marked = F.when(header & later, F.concat(F.lit("\n"), "line")).when(F.col("unit_type") == "bullet", F.concat(F.lit("$ "), "line")).otherwise(F.col("line"))
    rows = rows.select("doc_id", F.when(F.col("line") != "", F.struct("unit_order", "unit_id", marked.alias("line"))).alias("one"))
    lines = F.transform(F.array_sort(F.collect_list("one")), lambda x: x["line"])
    return rows.groupBy("doc_id").agg(F.array_join(lines, "\n").alias("text"), F.count("one").alias("n_units"))
