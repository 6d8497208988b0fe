"""Readers of the pool, logs, rosters; all with fixed schemas, none infers by reading the data twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLICK_LOG = "app_id string, target string, url string, ts string"
POOL_ROW = "url string, text string, title string, ts string"
POOL_LIMIT = 2000


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """Clicks from JSON (an array or one object a line); broken records are dropped, times without zone are UTC."""
    raw = spark.read.schema(CLICK_LOG + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(path)
    return raw.where("_corrupt is null and app_id is not null").select("app_id", "target", "url", F.try_to_timestamp("ts").alias("ts"))


def legacy_pool(spark: SparkSession, path: str, pool: DataFrame) -> DataFrame:
    """Rows of a legacy JSON pool that the pool lacks: with an address, first one of each address; nothing if the pool has rows."""
    rows = spark.read.schema(POOL_ROW).option("multiLine", True).json(path).where(F.coalesce(F.trim("url"), F.lit("")) != "")
    rows = rows.select("url", "text", "title", F.try_to_timestamp("ts").alias("scraped_at"))
    first = rows.groupBy("url").agg(F.min_by(F.struct("text", "title", "scraped_at"), F.struct("scraped_at", "text")).alias("row")).select("url", "row.*")
    return first if pool.isEmpty() else first.limit(0)


def roster_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header whose names are matched without case and white space; all cells are text."""
    rows = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*["_".join(c.strip().lower().split()) for c in rows.columns])


def lookback(now: Column, days: int | None, last_import: Column | None = None) -> Column:
    """The oldest time of interest: ``days`` (1 to 90) back, else the last import, else 30 days back."""
    if days is not None:
        return now - F.make_dt_interval(F.lit(max(1, min(90, days))))
    month = now - F.make_dt_interval(F.lit(30))
    return month if last_import is None else F.coalesce(last_import, month)


def pool_since(pool: DataFrame, cutoff: Column, limit: int = POOL_LIMIT) -> DataFrame:
    """The newest rows from ``cutoff`` on; the filter reaches the scan and the limit is a top-k."""
    return pool.where(F.col("scraped_at") >= cutoff).orderBy(F.desc("scraped_at"), F.desc("id")).limit(limit)
