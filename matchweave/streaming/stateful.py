"""Stateful stream operators; each has the batch form that its test compares it with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchweave.operators.folds import ordered_fold


def rate_limited(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """call_id, key, allowed: a call is allowed if fewer than ``most`` allowed calls of its key lie in the ``seconds`` before it.

    Denied calls leave no trace. State: the times of the allowed calls of one window, at most ``most`` of them."""

    def step(hits: list[float], row) -> tuple[list[float], tuple]:
        hits = [h for h in hits if h > row.at - seconds]
        allowed = len(hits) < most
        return (hits + [row.at] if allowed else hits), (row.call_id, row.key, allowed)

    rows = calls.select("call_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).select("call_id", "key", (F.col("us") / 1e6).alias("at"))
    return ordered_fold(rows, "key", ["at", "call_id"], list, step, "call_id long, key long, allowed boolean")


def rate_limited_stream(calls: DataFrame, most: int, seconds: int) -> DataFrame:
    """``rate_limited`` for a stream of calls that arrive in order of time per key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "call_id"])
        out = []
        for call_id, at in zip(rows["call_id"], rows["at"], strict=True):
            hits = [h for h in hits if h > at - seconds]
            allowed = len(hits) < most
            if allowed:
                hits.append(at)
            out.append((call_id, key[0], allowed))
        state.update((hits,))
        yield pd.DataFrame(out, columns=["call_id", "key", "allowed"])

    rows = calls.select("call_id", "key", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("at"))
    return rows.groupBy("key").applyInPandasWithState(run, "call_id long, key long, allowed boolean", "hits array<double>", "append", GroupStateTimeout.NoTimeout)


def fresh_clicks_stream(clicks: DataFrame) -> DataFrame:
    """app_id, seen, fresh: for each batch with clicks of an application, those not reported before. State: one count."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = sum(len(f) for f in frames)
        seen = (state.get[0] if state.exists else 0) + fresh
        state.update((seen,))
        yield pd.DataFrame({"app_id": [key[0]], "seen": [seen], "fresh": [fresh]})

    return clicks.groupBy("app_id").applyInPandasWithState(run, "app_id long, seen long, fresh long", "seen long", "append", GroupStateTimeout.NoTimeout)


def clicks_per_window(clicks: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, target, n for streams and tables alike; on streams, clicks later than ``late`` are dropped."""
    rows = clicks.withWatermark("ts", late) if clicks.isStreaming else clicks
    return rows.groupBy(F.window("ts", length).alias("w"), "target").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "target", "n")


def cache_states(entries: DataFrame, reads: DataFrame, valid_seconds: int = 3600, invalid_seconds: int = 30) -> DataFrame:
    """read_id, hit: whether the newest entry of the key before a read is still alive; entries for valid keys live longer."""
    life = F.when(F.col("valid"), valid_seconds).otherwise(invalid_seconds)
    marks = entries.select("key", "ts", F.lit(None).cast("long").alias("read_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + life).alias("until"))
    asks = reads.select("key", "ts", "read_id", F.lit(None).cast("double").alias("until"))
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("ts", F.col("read_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(asks).withColumn("until", F.last("until", ignorenulls=True).over(w))
    return rows.where("read_id is not null").select("read_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 < F.col("until"), F.lit(False)).alias("hit"))


def _gate(last: float | None, at: float, ok: bool, seconds: float) -> tuple[float | None, str]:
    if last is not None and at - last < seconds:
        return last, "fresh"
    return (at, "renewed") if ok else (last, "failed")


def gated(attempts: DataFrame, seconds: int) -> DataFrame:
    """attempt_id, key, outcome for attempts (attempt_id, key, ts, ok) in order: fresh within ``seconds`` of the last success of the
    key, else renewed, or failed (``ok`` is false or null), which leaves the time as it was, so that the next attempt tries
    again. A cache whose misses are filled is a gate that never fails. State: the time of the last success."""

    def step(last: float | None, row) -> tuple[float | None, tuple]:
        last, outcome = _gate(last, row.at, row.ok, seconds)
        return last, (row.attempt_id, row.key, outcome)

    return ordered_fold(_attempts(attempts), "key", ["at", "attempt_id"], lambda: None, step, "attempt_id long, key long, outcome string")


def _attempts(rows: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return rows.where("ts IS NOT NULL").select("attempt_id", "key", at.alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))


def gated_stream(attempts: DataFrame, seconds: int) -> DataFrame:
    """``gated`` for a stream of attempts that arrive in order of time per key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, out = pd.concat(list(frames)).sort_values(["at", "attempt_id"]), []
        for attempt_id, at, ok in zip(rows["attempt_id"], rows["at"], rows["ok"], strict=True):
            last, outcome = _gate(last, at, ok, seconds)
            out.append((attempt_id, key[0], outcome))
        state.update((last,))
        yield pd.DataFrame(out, columns=["attempt_id", "key", "outcome"])

    return _attempts(attempts).groupBy("key").applyInPandasWithState(run, "attempt_id long, key long, outcome string", "last double", "append", GroupStateTimeout.NoTimeout)
