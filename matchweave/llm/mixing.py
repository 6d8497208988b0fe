"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Training time runs from 0 to 1. Each source has a weight schedule: values at evenly spaced times, linear in between.

1. A source's weight is the integral of its schedule. The sources share all words by weight; a target stops at ``cap``
   times its source's words and the excess is shared again by weight (water-filling, solved in closed form over the
   sources sorted by cap / weight).
2. A source's documents stand in the order of the md5 of their id. The mix takes that sequence again and again until
   the target is met, so the target falls into whole passes and a remainder. The document in which the remainder ends
   is taken up to that word.
3. Each copy's place in its source's token demand is inverted through the cumulative schedule: the training position.
4. ``training_order`` range-sorts the copies by position.

Running sums are taken in two levels: sums per (source, leading digits of the md5), then a window inside each such
bucket. A source that holds most rows is so dealt over all tasks. Only sums per source and bucket pass through a window
over one source.

Defined cases: a null text has 0 words, and documents of 0 words are never taken. A null source is a source, last in
order. Rows with the same id stand next to each other and count each. A null id stands first. An empty table gives an
empty table. Columns of any other name pass through; those named in ``ADDED`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight schedules of the sources in code-point order, repeating. Their integrals are 5, 2 and 1.
SCHEDULES: tuple[tuple[float, ...], ...] = ((8.0, 2.0), (2.0, 2.0), (0.5, 1.5))
CAP = 3
#: Leading hexadecimal digits of the md5 that name a bucket of a source.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken", "positions")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Sequence[float]) -> float:
    return sum((a + b) / 2 for a, b in zip(schedule, schedule[1:])) / (len(schedule) - 1)


def _repeating(values: Sequence, rank: Column) -> Column:
    """The value at ``rank`` (from 1), the values repeating without end."""
    array = F.array(*[F.array(*map(F.lit, v)) if isinstance(v, (tuple, list)) else F.lit(v) for v in values])
    return F.element_at(array, ((rank - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = CAP) -> DataFrame:
    """``skey, source, source_size, schedule, target`` from ``skey, source, source_size``: one row per source.

    With the sources in order of cap / weight, source k stops at its cap if that ratio is at most (what is left of the
    total) / (what is left of the weight) before it. The largest such level over all k is the level of the rest.
    """
    weights = [float(integral(s)) for s in schedules]
    order = Window.orderBy(F.col("source").asc_nulls_last(), "skey")
    ranked = sizes.withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("schedule", _repeating([tuple(map(float, s)) for s in schedules], F.col("rank"))).withColumn("weight", _repeating(weights, F.col("rank")))
    by_ratio = Window.orderBy(F.col("source_size") * cap / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    zero = F.lit(0.0)
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum(F.col("source_size") * cap).over(before).cast("double"), zero)
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero))
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return leveled.select("skey", "source", "source_size", "schedule", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def position_of(share: Column, schedule: Column) -> Column:
    """The time (0 to 1) by which ``share`` of the schedule's integral has passed: a quadratic inside one segment."""
    step = 1.0 / (F.size(schedule) - 1)
    area = F.transform(F.sequence(F.lit(1), F.size(schedule) - 1), lambda i: (F.element_at(schedule, i) + F.element_at(schedule, i + 1)) / 2 * step)
    passed = F.aggregate(area, F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    need = share * F.element_at(passed, -1)
    segment = F.greatest(F.lit(1), F.least(F.size(schedule) - 1, F.size(F.filter(passed, lambda x: x < need))))
    first, last = F.element_at(schedule, segment), F.element_at(schedule, segment + 1)
    rest = need - F.element_at(passed, segment)
    slope = (last - first) / step
    root = first + F.sqrt(F.greatest(F.lit(0.0), first * first + 2 * slope * rest))
    return F.least(F.lit(1.0), (segment - 1) * step + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)))


def curriculum(docs: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` (with doc_id, text, source) plus size, source_size, target, taken (words, repeats counted) and
    positions: one training position for each copy the mix takes, in order; none where it takes nothing."""
    docs = docs.drop(*ADDED)
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    source = F.col("source").cast("string")
    docs = docs.withColumns({"size": word_count(F.col("text").cast("string")), "__key": key, "__skey": F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))})
    docs = docs.withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    sums = docs.groupBy("__skey", "__bucket").agg(F.sum("size").alias("held"), F.first("source").cast("string").alias("source"))
    buckets = sums.withColumn("ahead", F.coalesce(F.sum("held").over(Window.partitionBy("__skey").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = source_targets(sums.groupBy(F.col("__skey").alias("skey")).agg(F.first("source").alias("source"), F.sum("held").alias("source_size")), schedules, cap)
    plan = buckets.drop("source").join(sources.drop("source"), F.col("__skey") == F.col("skey")).select(
        F.col("__skey").alias("__s"), F.col("__bucket").alias("__b"), F.col("ahead").alias("__ahead"), "source_size", F.col("schedule").alias("__schedule"), "target"
    )
    placed = docs.join(plan, (F.col("__skey") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    inside = Window.partitionBy("__skey", "__bucket").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__before", F.col("__ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    size, before, total, target = F.col("size"), F.col("__before"), F.col("source_size"), F.col("target")
    passes = F.when(total > 0, F.floor(target / total)).otherwise(F.lit(0)).cast("long")
    rest = F.round(target - passes * total).cast("long")
    last = F.greatest(F.lit(0), F.least(size, rest - before))
    placed = placed.withColumn("__passes", F.when(size > 0, passes).otherwise(F.lit(0))).withColumn("__last", last.cast("long"))
    copies = F.col("__passes") + F.when(F.col("__last") > 0, 1).otherwise(0)
    share = lambda i: (i * total + before + F.when(i < F.col("__passes"), size).otherwise(F.col("__last")) / F.lit(2.0)) / target
    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)).cast("int") - 1), lambda i: position_of(share(i), F.col("__schedule")))).otherwise(F.array().cast("array<double>"))
    out = placed.withColumn("taken", F.col("__passes") * size + F.col("__last")).withColumn("positions", positions)
    return out.drop("__key", "__skey", "__bucket", "__s", "__b", "__ahead", "__schedule", "__before", "__passes", "__last")


def by_first_position(mix: DataFrame) -> DataFrame:
    """The rows of ``curriculum`` range-sorted by their first position; those never taken come last."""
    first = F.try_element_at("positions", F.lit(1)).alias("position")
    mix = mix.withColumn("position", first)
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return mix.repartitionByRange(*keys).sortWithinPartitions(*keys)


def training_order(mix: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position. The text of a copy that ends in mid-document is cut after its
    last word taken; ``copy`` counts from 0. Columns named copy or position are replaced."""
    rows = mix.drop("copy", "position").select("*", F.posexplode("positions").alias("copy", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")
    rows = rows.withColumn("text", F.when(words < F.col("size"), cut).otherwise(F.col("text")))
    keys = ["position", "doc_id", "copy"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix in training order, in the columns of ``docs``, whatever their names."""
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    out = training_order(curriculum(docs.select("doc_id", "text", "source", others.alias("__row"))))
    return out.select(*[F.col("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns])


#: DuckDB SQL for the rows of the mixing query.
SQL = """
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rn - 1) % 3 + 1] AS weight,
         [8.0::DOUBLE, 2.0::DOUBLE, 0.5::DOUBLE][(rn - 1) % 3 + 1] AS y0,
         [2.0::DOUBLE, 2.0::DOUBLE, 1.5::DOUBLE][(rn - 1) % 3 + 1] AS y1
  FROM r
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce((sum(source_size * 3) OVER before)::DOUBLE, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w
  WINDOW before AS (ORDER BY source_size * 3 / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT doc_id, size, source_size, target, y0, y1,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h NULLS FIRST, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN source_size > 0 AND size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS all_passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, round(target - all_passes * source_size)::BIGINT - before))::BIGINT AS last FROM p
), u AS (
  SELECT *, CASE WHEN passes > 0 THEN size ELSE last END AS first_words FROM q
), a AS (
  SELECT *, (before + first_words / 2.0::DOUBLE) / target * ((y0 + y1) / 2) AS need FROM u
)
SELECT doc_id, size, source_size, target, (passes * size + last)::BIGINT AS taken,
       CASE WHEN passes > 0 OR last > 0
            THEN round(least(1.0::DOUBLE, 2 * need / (y0 + sqrt(greatest(0, y0 * y0 + 2 * (y1 - y0) * need)))), 6) END AS position
FROM a
"""
