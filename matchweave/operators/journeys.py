"""Transactions whose refusals leave no trace, as ordered folds: referral requests with their answers and expiry, the bank of answers, lists of recent addresses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.functions.text import stripped
from matchweave.operators.folds import ordered_fold

COST, TERM_DAYS, MOST_ANSWERS, SHORTEST, RECENT, RECENT_HOURS = 5, 7, 100, 4, 5, 4
#: Fixed text of a question left open.
UNANSWERED = "לא ענה"


def referrals(rows: DataFrame, cost: int = COST, days: int = TERM_DAYS) -> DataFrame:
    """entry_id, user_id, outcome, balance of each row (entry_id, user_id, ts, kind, credit, job, found) in order.

    ``credit`` raises the balance (credited). ``request`` is refused without a job (no_job), an employee (nobody), beside a
    pending or accepted one for the job (active) or enough points (short), else it costs ``cost`` (pending). ``accept`` and
    ``decline`` resolve the pending request of the job (accepted; declined, with refund), else they are late (handled).
    Requests that pend for more than ``days`` are refunded before the user's next row. State: the user's open requests."""
    term = pd.Timedelta(days=days)

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        balance, pending, accepted = state
        late = [job for job, ts in pending.items() if ts + term < row.ts]
        for job in late:
            del pending[job]
        balance += cost * len(late)
        job = None if pd.isna(row.job) else row.job
        if row.kind == "credit":
            balance, outcome = balance + row.credit, "credited"
        elif row.kind != "request":
            outcome = "handled"
            if job in pending:
                del pending[job]
                outcome = "accepted" if row.kind == "accept" else "declined"
                if row.kind == "accept":
                    accepted.add(job)
                else:
                    balance += cost
        elif job is None or job == "":
            outcome = "no_job"
        elif not row.found:
            outcome = "nobody"
        elif job in pending or job in accepted:
            outcome = "active"
        elif balance < cost:
            outcome = "short"
        else:
            balance, outcome = balance - cost, "pending"
            pending[job] = row.ts
        return (balance, pending, accepted), (row.entry_id, row.user_id, outcome, balance)

    rows = rows.select("entry_id", "user_id", "ts", "kind", F.coalesce("credit", F.lit(0)).alias("credit"), "job", F.coalesce("found", F.lit(False)).alias("found"))
    return ordered_fold(rows, "user_id", ["ts", "entry_id"], lambda: (0, {}, set()), step, "entry_id long, user_id long, outcome string, balance long")


def banked_answers(rows: DataFrame, most: int = MOST_ANSWERS) -> DataFrame:
    """entry_id, user_id, outcome, dropped for answers (entry_id, user_id, ts, skill, answer), each an update of its own:
    skipped (open or under four characters), updated in place (the skill, letter case aside, is in the bank) or added in
    front; ``dropped`` is the skill that an added one pushes over the end of ``most``. State: the user's bank."""

    def step(bank: list, row) -> tuple[list, tuple]:
        outcome, dropped = "skipped", None
        if row.usable:
            outcome = "updated" if row.skill in bank else "added"
            if outcome == "added":
                bank.insert(0, row.skill)
                dropped = bank.pop() if len(bank) > most else None
        return bank, (row.entry_id, row.user_id, outcome, dropped)

    said = stripped(F.coalesce("answer", F.lit("")))
    rows = rows.select("entry_id", "user_id", "ts", F.lower(F.coalesce("skill", F.lit(""))).alias("skill"), ((said != UNANSWERED) & (F.length(said) >= SHORTEST)).alias("usable"))
    return ordered_fold(rows, "user_id", ["ts", "entry_id"], list, step, "entry_id long, user_id long, outcome string, dropped string")


def recent_lists(rows: DataFrame, most: int = RECENT, hours: int = RECENT_HOURS) -> DataFrame:
    """entry_id, user_id, outcome, dropped for rows (entry_id, user_id, ts, kind, url): ``save`` puts the address in front
    (saved; ``dropped`` is what leaves a list of ``most``), ``load`` finds it (hit), finds it older than ``hours`` and removes
    it (stale) or doesn't (miss). A row without an address is a miss. State: the user's list."""
    life = pd.Timedelta(hours=hours)

    def step(held: dict, row) -> tuple[dict, tuple]:
        outcome, dropped = "miss", None
        if row.url is not None and row.kind == "save":
            outcome = "saved"
            held.pop(row.url, None)
            held[row.url] = row.ts
            if len(held) > most:
                dropped = next(iter(held))
                del held[dropped]
        elif row.url in held:
            outcome = "stale" if row.ts - held[row.url] > life else "hit"
            if outcome == "stale":
                del held[row.url]
        return held, (row.entry_id, row.user_id, outcome, dropped)

    return ordered_fold(rows.select("entry_id", "user_id", "ts", "kind", "url"), "user_id", ["ts", "entry_id"], dict, step, "entry_id long, user_id long, outcome string, dropped string")


def tracked_edits(rows: DataFrame) -> DataFrame:
    """entry_id, user_id, kind, job_id touched (null: none), value, for rows (entry_id, user_id, ts, kind, job_id, url, value).

    ``add`` saves a job, ``status`` and ``delete`` name one by its id, ``sent`` and ``referral`` mean the newest saved job of an
    address that isn't deleted. State: the user's jobs by address."""

    def step(held: dict, row) -> tuple[dict, tuple]:
        urls, jobs = held
        job = row.job_id if row.kind in ("status", "delete") and row.job_id in jobs else None
        if row.kind == "add" and row.job_id not in jobs:
            job = row.job_id
            jobs[job] = row.url
            urls.setdefault(row.url, []).append(job)
        elif row.kind in ("sent", "referral") and row.url is not None and urls.get(row.url):
            job = urls[row.url][-1]
        elif row.kind == "delete" and job is not None:
            urls[jobs.pop(job)].remove(job)
        return held, (row.entry_id, row.user_id, row.kind, job, row.value)

    # ids travel as strings: as numbers, nulls among them would make them inexact
    rows = rows.select("entry_id", "user_id", "ts", "kind", F.col("job_id").cast("string").alias("job_id"), "url", "value")
    out = ordered_fold(rows, "user_id", ["ts", "entry_id"], lambda: ({}, {}), step, "entry_id long, user_id long, kind string, job_id string, value string")
    return out.withColumn("job_id", F.col("job_id").cast("long"))


def tracked_jobs(rows: DataFrame) -> DataFrame:
    """user_id, job_id, status, sent, referral of the jobs that are left after all edits: the last value of each wins."""
    order = F.struct("ts", "entry_id")
    edits = tracked_edits(rows).where("job_id IS NOT NULL").join(rows.select("entry_id", "ts"), "entry_id")
    last = lambda *kinds: F.max_by("value", F.when(F.col("kind").isin(*kinds), order))
    is_ = lambda kind: F.max(F.col("kind") == kind)
    out = edits.groupBy("user_id", "job_id").agg(last("add", "status").alias("status"), is_("sent").alias("sent"), last("referral").alias("referral"), is_("delete").alias("gone"))
    return out.where("NOT gone").drop("gone")
