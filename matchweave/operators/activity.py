"""Dashboards over tracked applications and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = {"github": "GitHub", "linkedin": "LinkedIn", "portfolio": "Portfolio"}
NO_PLATFORM = "Other"


def kpis(jobs: DataFrame) -> DataFrame:
    """One row: total, submitted, cv_generated, avg_score (missing scores count 0; 0 without jobs)."""
    return jobs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "submitted").alias("submitted"),
        F.count_if("cv_generated").alias("cv_generated"),
        F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0)))), F.lit(0)).cast("long").alias("avg_score"),
    )


def funnel(jobs: DataFrame) -> DataFrame:
    """stage, n, pct of all: viewed, scored, generated, submitted, from one pass."""
    one = jobs.agg(F.count("*").alias("viewed"), F.count_if(F.col("score") > 0).alias("scored"), F.count_if("cv_generated").alias("generated"), F.count_if(F.col("status") == "submitted").alias("submitted"))
    rows = one.selectExpr("viewed AS total", "stack(4, 'viewed', viewed, 'scored', scored, 'generated', generated, 'submitted', submitted) AS (stage, n)")
    return rows.select("stage", "n", F.when(F.col("total") > 0, F.round(F.col("n") * 100 / F.col("total"))).otherwise(0).cast("long").alias("pct"))


def platforms(jobs: DataFrame) -> DataFrame:
    """platform, n, first_seen, place: most used first, ties by first appearance. A missing name is NO_PLATFORM; a blank one
    trims to its own group."""
    name = F.trim(F.when(F.coalesce("platform", F.lit("")) == "", NO_PLATFORM).otherwise(F.col("platform")))
    counted = jobs.groupBy(name.alias("platform")).agg(F.count("*").alias("n"), F.min("job_id").alias("first_seen"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")))


def click_report(jobs: DataFrame, clicks: DataFrame) -> DataFrame:
    """Every job with its clicks: number, last one (ties: the later click) and the labels of its targets, first seen first.

    Clicks are summed per application before the join: at most one row for each target and application meets it."""
    per_target = clicks.groupBy("app_id", "target").agg(F.count("*").alias("n"), F.min("click_id").alias("first_click"), F.max(F.struct("ts", "click_id")).alias("last"))
    label = F.coalesce(*[F.when(F.col("target") == k, v) for k, v in LABELS.items()], F.col("target"))
    per_app = per_target.groupBy("app_id").agg(F.sum("n").alias("n_clicks"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("first_click", label.alias("label")))).alias("seen"))
    per_app = per_app.select("app_id", "n_clicks", F.col("last.ts").alias("last_click"), F.array_join(F.transform("seen", lambda x: x["label"]), ", ").alias("targets"))
    return jobs.join(per_app, "app_id", "left").select("job_id", "app_id", F.coalesce("n_clicks", F.lit(0)).cast("long").alias("n_clicks"), "last_click", F.coalesce("targets", F.lit("")).alias("targets"))


def newest_clicked(jobs: DataFrame, clicks: DataFrame) -> DataFrame:
    """job_id of the application with the globally newest click; of jobs that tie, the first saved."""
    last = clicks.groupBy("app_id").agg(F.max("ts").alias("ts"))
    return jobs.join(last.withColumnRenamed("ts", "clicked"), "app_id").agg(F.max_by("job_id", F.struct("clicked", (-F.col("job_id")).alias("first"))).alias("job_id"))


def new_clicks(clicks: DataFrame, seen: DataFrame) -> DataFrame:
    """app_id, fresh: clicks beyond the number already seen, where there are any."""
    counted = clicks.groupBy("app_id").agg(F.count("*").alias("n"))
    rows = counted.join(seen, "app_id", "left").select("app_id", (F.col("n") - F.coalesce("seen", F.lit(0))).alias("fresh"))
    return rows.where("fresh > 0")


def recent(jobs: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest rows: a top-k per task, then of those."""
    return jobs.orderBy(F.desc("ts"), F.desc("job_id")).limit(k)


def latest_per_key(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The ``k`` newest rows of each key, with their place."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
