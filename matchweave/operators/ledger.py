"""Points ledger: balances, daily credits, admission of charges, capped awards, refunds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import ordered_fold

DAILY_CAP = 5
#: Adding or enriching a recruiter or an employee: one daily cap for all four.
CREDITS = ("recruiter_added_new", "recruiter_enriched", "employee_added_new", "employee_enriched")


def balances(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """user_id, balance: the sum of deltas, 0 for users without entries. The ledger is summed before it is joined."""
    sums = ledger.groupBy("user_id").agg(F.sum("delta").alias("total"))
    return users.join(sums, "user_id", "left").select("user_id", F.coalesce("total", F.lit(0)).cast("long").alias("balance"))


def daily_credits(ledger: DataFrame) -> DataFrame:
    """user_id, day, credits: credited directory actions of each UTC day."""
    day = F.date_trunc("DAY", "ts").alias("day")
    return ledger.where(F.col("action").isin(*CREDITS)).groupBy("user_id", day).agg(F.count("*").alias("credits"))


def history(ledger: DataFrame) -> DataFrame:
    """Every entry with the running balance of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return ledger.select("entry_id", "user_id", "delta", F.sum("delta").over(w).alias("balance"))


def points_summary(ledger: DataFrame) -> DataFrame:
    """One row: points issued (refunds count as issued), points spent, entries, users. No shuffle but one row a task."""
    positive, negative = F.when(F.col("delta") > 0, F.col("delta")), F.when(F.col("delta") < 0, F.col("delta"))
    return ledger.agg(F.coalesce(F.sum(positive), F.lit(0)).alias("issued"), F.abs(F.coalesce(F.sum(negative), F.lit(0))).alias("spent"), F.count("*").alias("entries"), F.countDistinct("user_id").alias("users"))


def admitted_charges(ledger: DataFrame) -> DataFrame:
    """entry_id, user_id, delta, accepted, balance: a charge above the balance is rejected and changes nothing."""

    def step(balance: int, row) -> tuple[int, tuple]:
        accepted = row.delta >= 0 or balance + row.delta >= 0
        balance += row.delta if accepted else 0
        return balance, (row.entry_id, row.user_id, row.delta, accepted, balance)

    rows = ledger.select("entry_id", "user_id", "delta", "ts")
    return ordered_fold(rows, "user_id", ["ts", "entry_id"], int, step, "entry_id long, user_id long, delta long, accepted boolean, balance long")


def capped_awards(ledger: DataFrame, cap: int = DAILY_CAP) -> DataFrame:
    """entry_id, user_id, outcome: 'awarded', 'repeat' (this user, record and action was awarded before) or 'capped'.

    A capped attempt leaves no trace, so a later one for the same record can be awarded."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        seen, day, n = state
        if row.day != day:
            day, n = row.day, 0
        outcome = "repeat" if (row.ref_id, row.action) in seen else "capped" if n >= cap else "awarded"
        if outcome == "awarded":
            seen.add((row.ref_id, row.action))
            n += 1
        return (seen, day, n), (row.entry_id, row.user_id, outcome)

    rows = ledger.where(F.col("action").isin(*CREDITS)).select("entry_id", "user_id", "action", "ref_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return ordered_fold(rows, "user_id", ["ts", "entry_id"], lambda: (set(), None, 0), step, "entry_id long, user_id long, outcome string")


def refunds(ledger: DataFrame) -> DataFrame:
    """ref_id, user_id, entry_id, refund: for each user and reference, the reversal of the most recent charge."""
    last = F.max(F.struct("ts", "entry_id", "delta")).alias("last")
    return ledger.where("delta < 0").groupBy("user_id", "ref_id").agg(last).select("ref_id", "user_id", "last.entry_id", (-F.col("last.delta")).alias("refund"))


def monthly_usage(ledger: DataFrame) -> DataFrame:
    """user_id, month (yyyy-MM, UTC), uses."""
    return ledger.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("uses"))


def openings(attempts: DataFrame, contacts: DataFrame, cost: int = 1) -> DataFrame:
    """entry_id, user_id, outcome, balance of attempts (entry_id, user_id, ts, credit, contact_id, job) to open a contact's
    address, in order: unknown (no such contact), repeat (this user opened it for this job before), short (the balance does
    not cover the cost) or opened; rows with a credit only raise the balance. Refused attempts leave no trace.

    A user's state holds what the user has opened, so it grows with that, not with the attempts."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        balance, seen = state
        if row.credit:
            balance, outcome = balance + row.credit, "credited"
        elif not row.known:
            outcome = "unknown"
        elif (row.contact_id, row.job) in seen:
            outcome = "repeat"
        elif balance < cost:
            outcome = "short"
        else:
            balance, outcome = balance - cost, "opened"
            seen.add((row.contact_id, row.job))
        return (balance, seen), (row.entry_id, row.user_id, outcome, balance)

    known = contacts.select("contact_id").distinct().withColumn("known", F.lit(True))
    rows = attempts.join(known, "contact_id", "left").select("entry_id", "user_id", "ts", "credit", "contact_id", "job", F.coalesce("known", F.lit(False)).alias("known"))
    return ordered_fold(rows, "user_id", ["ts", "entry_id"], lambda: (0, set()), step, "entry_id long, user_id long, outcome string, balance long")


def admin_stats(people: DataFrame, ledger: DataFrame) -> DataFrame:
    """metric, part, n: contacts (all, verified), entries by action, users, points issued and spent. Each table is read once."""
    of_people = people.agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"))
    of_people = of_people.selectExpr("stack(2, 'recruiters', 'total', total, 'recruiters', 'verified', verified) AS (metric, part, n)")
    sums = ledger.groupBy("action", "user_id").agg(F.count("*").alias("n"), F.sum(F.greatest("delta", F.lit(0))).alias("issued"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("spent"))
    actions = sums.groupBy("action").agg(F.sum("n").alias("n")).select(F.lit("action").alias("metric"), F.col("action").alias("part"), "n")
    whole = sums.agg(F.countDistinct("user_id").alias("users"), F.coalesce(F.sum("issued"), F.lit(0)).alias("issued"), F.coalesce(F.sum("spent"), F.lit(0)).alias("spent"))
    whole = whole.selectExpr("stack(3, 'users', 'total', users, 'points', 'issued', issued, 'points', 'spent', spent) AS (metric, part, n)")
    return of_people.union(actions).union(whole)
