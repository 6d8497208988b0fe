"""Rewritten documents: verdicts on returned blocks, why a text changed, modes of an analysis, the slice to read, page tiers, scores of answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.text import stripped
from matchweave.operators.documents_cv import section_lines

SHRUNK, KEPT = 0.95, 0.6
#: Fixed patterns of the lines that begin a part of an analysis.
MODES = (("strength", r"(?i)חוזק|strength|יתרון|חיובי"), ("gap", r"(?i)פער|חסר|gap|weakness|לשפר|missing|בעי"), ("neutral", r"(?i)המלצ|לסיכום|conclusion|summary"))
#: Fixed headings at which a description begins. A word boundary is one of ASCII words, so Hebrew headings need such a word after them.
ANCHOR = (
    r"(?i)^\s*(?:(?:requirements?|qualifications?|responsibilities|about the (?:role|job)|the role|what you'?ll (?:do|need)|we(?:'| a)re looking for|must have|nice to have)(?:[^a-z0-9_]|$)"
    r"|(?:דרישות(?: התפקיד)?|תיאור התפקיד|מה נדרש|על התפקיד)[a-z0-9_])"
)
LEAD = 25
#: Fixed sizes of the tiers: type in points, margin in twentieths of a point; A4 in points.
TIERS = (("normal", 10.5, 720), ("tight", 10.0, 620), ("compact", 9.5, 560))
A4 = (595.28, 841.89)
LINE_HEIGHT, GLYPH, INDENT = 1.25, 0.5, 4
HEADED, INDENTED = ("PROFILE", "EXPERIENCE", "EDUCATION", "SKILLS", "LANGUAGES"), ("EXPERIENCE", "EDUCATION")


def block_verdicts(blocks: DataFrame, returned: DataFrame) -> DataFrame:
    """doc_id, block, verdict of returned (doc_id, block, text) blocks against blocks (doc_id, block, text, focus, shrink):
    not_requested, shrink_not_shorter, expand_got_shorter or kept. A block to be both expanded and shrunk is expanded."""
    asked = blocks.select("doc_id", "block", F.length(F.coalesce("text", F.lit(""))).alias("before"), "focus", (F.col("shrink") & ~F.col("focus")).alias("shrink"))
    after = F.length("text")
    verdict = (
        F.when(F.coalesce(after, F.lit(0)) == 0, "not_requested")
        .when(~F.coalesce(F.col("focus") | F.col("shrink"), F.lit(False)), "not_requested")
        .when(F.col("shrink") & (after >= F.col("before") * SHRUNK), "shrink_not_shorter")
        .when(F.col("focus") & (after < F.col("before") * KEPT), "expand_got_shorter")
        .otherwise("kept")
    )
    return returned.join(asked, ["doc_id", "block"], "left").select("doc_id", "block", verdict.alias("verdict"))


def change_reason(old: Column, new: Column) -> Column:
    """new, emphasised, measured, shortened or adapted: the first that holds; a null text is an empty one."""
    old, new = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    marks = lambda x: F.regexp_count(x, F.lit(r"\*\*"))
    return (
        F.when(old == "", "new")
        .when(marks(new) > marks(old), "emphasised")
        .when(new.rlike("[0-9]") & ~old.rlike("[0-9]"), "measured")
        .when(F.length(new) < F.length(old) * 0.8, "shortened")
        .otherwise("adapted")
    )


def analysis_modes(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, mode: the part of an analysis that a line belongs to, its own first line included; neutral before any."""
    mark = F.lit(None).cast("string")
    for mode, pattern in reversed(MODES):
        mark = F.when(F.col("line").rlike(pattern), mode).otherwise(mark)
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("mark", mark).select("doc_id", "line_no", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("neutral")).alias("mode"))


def description(text: Column, lead: int = LEAD) -> Column:
    """The text from ``lead`` lines before the first heading of a description on; all of it if there is none or it comes first."""
    lines = F.split(text, "\n")
    found = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(ANCHOR), i)), lambda i: i.isNotNull())
    start = F.greatest(F.lit(0), F.coalesce(F.get(found, F.lit(0)), F.lit(0)) - lead)
    return F.array_join(F.slice(lines, start + 1, F.size(lines)), "\n")


def page_tiers(docs: DataFrame) -> DataFrame:
    """doc_id, tier, lines, most_lines: the first tier in which a document with marked sections fits one page, else the last.

    Lines are counted for all tiers at once, so a document's lines are dealt once. Lengths are in code points."""
    lines = section_lines(docs).withColumn("t", stripped(F.col("line")))
    t, section = F.col("t"), F.col("section")
    bullet = section.isin(*INDENTED) & ~F.startswith(t, F.lit("**")) & t.rlike(r"^(?:\$ |\* |[•\-–—]\s)")
    counted, room = [], {}
    for name, points, margin in TIERS:
        inner = [side - margin / 20 * 2 for side in A4]
        wide = max(20, math.floor(inner[0] / (points * GLYPH)))
        room[name] = math.floor(inner[1] / (points * LINE_HEIGHT))
        usable = F.when(bullet, max(10, wide - INDENT)).otherwise(max(10, wide))
        counted.append(F.sum(F.when(section.isin(*HEADED), F.ceil(F.length(t) / usable))).alias(name))
    present = lambda s: F.max((section == s).cast("int"))
    headings = sum((present(s) for s in (*HEADED, "NAME", "HEADLINE")), F.lit(0))
    contact = F.least(F.lit(2), F.ceil(F.count_if(section == "CONTACT") / 2))
    sums = lines.groupBy("doc_id").agg(*counted, (headings + contact).alias("around"))
    rows = docs.select("doc_id").join(sums, "doc_id", "left")
    total = lambda name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce("around", F.lit(0)) + 1
    option = lambda name: F.struct(F.lit(name).alias("tier"), total(name).cast("long").alias("lines"), F.lit(room[name]).cast("long").alias("most_lines"))
    names = [name for name, _, _ in TIERS]
    best = F.coalesce(*[F.when(total(name) <= room[name], option(name)) for name in names], option(names[-1]))
    return rows.withColumn("best", best).select("doc_id", "best.*")


def answered_scores(sets: DataFrame, questions: DataFrame) -> DataFrame:
    """set_id, score, gap_pct, n_questions for sets (set_id, base) and questions (set_id, weight, pct): the base and each
    answer's share of its weight, rounded half up, 100 at most; the gap is the sum of weights from 10 to 40, 20 without any;
    a gap of 20 asks four questions, a smaller one three. Weights and shares are whole numbers, so sums are exact."""
    sums = questions.groupBy("set_id").agg(F.sum(F.coalesce("pct", F.lit(0)) * F.coalesce("weight", F.lit(0))).alias("points"), F.sum("weight").alias("total"))
    raw = F.floor((F.coalesce("base", F.lit(0)) * 100 + F.coalesce("points", F.lit(0)) + 50) / 100)
    gap = F.least(F.lit(40), F.greatest(F.lit(10), F.coalesce(F.when(F.col("total") != 0, F.col("total")), F.lit(20))))
    return sets.join(sums, "set_id", "left").select("set_id", F.least(F.lit(100), raw).cast("long").alias("score"), gap.cast("long").alias("gap_pct"), F.when(gap >= 20, 4).otherwise(3).cast("long").alias("n_questions"))
