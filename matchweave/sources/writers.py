"""Sinks: pool inserts, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_CHARS, TITLE_CHARS = 5000, 200
EXPORT_CHARS = {"title": 255, "url": 1024, "pro": 500, "con": 500, "date": 10}
EXPORT_ROWS = 1000


def classified(batch: DataFrame, pool: DataFrame) -> DataFrame:
    """The batch with ``outcome``: skipped (no http address or no text), duplicate (in the pool or earlier in the batch), saved."""
    usable = F.col("url").rlike("^https?://") & (F.coalesce(F.trim("text"), F.lit("")) != "")
    rows = batch.withColumn("usable", F.coalesce(usable, F.lit(False)))
    firsts = rows.where("usable").groupBy("url").agg(F.min("seq").alias("first"))
    held = pool.select("url").distinct().withColumn("held", F.lit(True))
    rows = rows.join(firsts, "url", "left").join(held, "url", "left")
    outcome = F.when(~F.col("usable"), "skipped").when(F.coalesce("held", F.lit(False)) | (F.col("seq") != F.col("first")), "duplicate").otherwise("saved")
    return rows.withColumn("outcome", outcome).drop("usable", "first", "held")


def insertable(batch: DataFrame, pool: DataFrame) -> DataFrame:
    """The rows to append, with texts and titles cut to the pool's limits."""
    rows = classified(batch, pool).where("outcome = 'saved'").drop("outcome")
    return rows.withColumns({"text": F.substring("text", 1, TEXT_CHARS), "title": F.substring("title", 1, TITLE_CHARS)})


def export_rows(rows: DataFrame) -> DataFrame:
    """The best EXPORT_ROWS rows with cells cut to the export's limits and whole scores."""
    cut = {c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n) for c, n in EXPORT_CHARS.items()}
    return rows.withColumns(cut | {"score": F.coalesce(F.col("score").cast("int"), F.lit(0))}).orderBy(F.desc("score"), "url").limit(EXPORT_ROWS)


def write_quoted_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, with a header in each file."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").mode("overwrite").csv(path)
