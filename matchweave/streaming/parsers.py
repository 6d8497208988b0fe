"""Parsers of token streams: marked questions, an analysis with its strategy, and lines cut across chunks.

Chunks (stream_id, seq, chunk) are parsed as they arrive, with the unfinished rest of a stream as its state; the batch forms read
whole texts by expressions. How a text is cut into chunks changes nothing: a marker that is cut is held back until it is whole, and
of two markers the earlier one counts. A stream's chunks come in order of seq; one stream is one task by its nature, and its state is
at most the unfinished question, explanation or line (an analysis is held until its summary begins).

Departures: the tail held back is as long as the longest marker needs (15 characters), and the text of an unfinished question is
given out at the end of its stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Markers.
META, EXPLAIN, EXPLAINED, DONE, STRATEGY, SUMMARY = "[META]", "[EXPL]", "[/EXPL]", "[QUESTIONS_DONE]", "###STRATEGY###", "###SUMMARY###"
HELD = len(DONE) - 1
FITS = ("high_fit", "niche_fit")
DECISION = r"DECISION:\s*(high_fit|niche_fit)"
SPACE = " \t\r\n\f\v"
QUESTION = r"(?s)\[META\][ \t]*(\{[^\n]*)\n(.*?)(?:\[EXPL\](?:(.*?)(\[/EXPL\])|.*\z)|\z)"

Event = tuple[str, int, str]


class Questions:
    """Events (kind, nth question, value): open with the meta line, text in parts, close with the explanation."""

    def __init__(self, mode: str = "meta", buffer: str = "", nth: int = 0):
        self.mode, self.buffer, self.nth = mode, buffer, nth

    def state(self) -> tuple:
        return self.mode, self.buffer, self.nth

    def feed(self, chunk: str, last: bool = False) -> Iterator[Event]:
        if self.mode == "done":
            return
        self.buffer += chunk
        end = self.buffer.find(DONE)
        if end >= 0:
            self.buffer, last = self.buffer[:end], True
        yield from self._drain()
        if last:
            if self.mode == "text" and self.buffer:
                yield "text", self.nth, self.buffer
            self.mode, self.buffer = "done", ""
        elif self.mode == "text" and len(self.buffer) > HELD:
            yield "text", self.nth, self.buffer[:-HELD]
            self.buffer = self.buffer[-HELD:]

    def _drain(self) -> Iterator[Event]:
        while True:
            if self.mode == "meta":
                at = self.buffer.find(META)
                if at < 0:
                    self.buffer = self.buffer[-HELD:]
                    return
                self.buffer = self.buffer[at:]
                line = self.buffer.find("\n")
                if line < 0:
                    return
                meta = self.buffer[len(META) : line].lstrip(" \t")
                if meta.startswith("{"):
                    self.nth += 1
                    self.mode, self.buffer = "text", self.buffer[line + 1 :]
                    yield "open", self.nth, meta
                else:  # no meta: look on behind the mark
                    self.buffer = self.buffer[len(META) :]
            elif self.mode == "text":
                at = self.buffer.find(EXPLAIN)
                if at < 0:
                    return
                if at:
                    yield "text", self.nth, self.buffer[:at]
                self.mode, self.buffer = "explanation", self.buffer[at + len(EXPLAIN) :]
            else:
                at = self.buffer.find(EXPLAINED)
                if at < 0:
                    return
                yield "close", self.nth, self.buffer[:at].strip(SPACE)
                self.mode, self.buffer = "meta", self.buffer[at + len(EXPLAINED) :]


class Analysis:
    """Events: strategy once (what stands before the summary, for ``strategies``), then the summary in parts."""

    def __init__(self, mode: str = "private", buffer: str = "", nth: int = 0):
        self.mode, self.buffer, self.nth = mode, buffer, nth

    def state(self) -> tuple:
        return self.mode, self.buffer, self.nth

    def feed(self, chunk: str, last: bool = False) -> Iterator[Event]:
        self.buffer += chunk
        if self.mode == "private":
            before, mark, after = self.buffer.partition(SUMMARY)
            if mark or last:
                yield "strategy", 0, before
                self.mode, self.buffer = "blank", after
        if self.mode == "blank":  # line ends right behind the mark go
            self.buffer = self.buffer.lstrip("\n")
            if self.buffer:
                self.mode = "summary"
        if self.mode == "summary" and self.buffer:
            yield "text", 0, self.buffer
            self.buffer = ""


class Lines:
    """Events: each whole line; an unfinished last line is kept, and dropped at the end of the stream."""

    def __init__(self, mode: str = "", buffer: str = "", nth: int = 0):
        self.mode, self.buffer, self.nth = mode, buffer, nth

    def state(self) -> tuple:
        return self.mode, self.buffer, self.nth

    def feed(self, chunk: str, last: bool = False) -> Iterator[Event]:
        *whole, self.buffer = (self.buffer + chunk).split("\n")
        for line in whole:
            self.nth += 1
            yield "line", self.nth, line


def events_stream(chunks: DataFrame, parser: type) -> DataFrame:
    """stream_id, kind, nth, value for a stream of chunks (stream_id, seq, chunk, last: whether it ends its stream)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p = parser(*json.loads(state.get[0])) if state.exists else parser()
        rows = pd.concat(list(frames)).sort_values("seq")
        out = [(key[0], *e) for chunk, last in zip(rows["chunk"], rows["last"], strict=True) for e in p.feed(chunk or "", bool(last))]
        state.update((json.dumps(p.state()),))
        yield pd.DataFrame(out, columns=["stream_id", "kind", "nth", "value"])

    rows = chunks.select("stream_id", "seq", "chunk", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, kind string, nth long, value string", "held string", "append", GroupStateTimeout.NoTimeout)


def cut(text: Column, size: Column) -> Column:
    """The text in pieces of ``size`` characters, the last one shorter; an empty text is one empty piece. It is read once from
    end to end: substrings by place would each begin to count at its start."""
    pieces = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces)


def whole_texts(chunks: DataFrame) -> DataFrame:
    """stream_id, text: the chunks of each stream laid end to end; null chunks are empty."""
    rows = chunks.select("stream_id", "seq", F.coalesce("chunk", F.lit("")).alias("chunk"))
    return rows.groupBy("stream_id").agg(F.expr("listagg(chunk, '') WITHIN GROUP (ORDER BY seq, chunk)").alias("text"))


def questions(texts: DataFrame) -> DataFrame:
    """stream_id, nth, question_id, text, explanation (null: not finished) of each marked question before the end mark."""
    text = F.col("t")
    rows = texts.select("stream_id", F.substring_index(F.coalesce("text", F.lit("")), DONE, 1).alias("t"))
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(QUESTION), F.lit(k)).alias(n) for k, n in ((1, "meta"), (2, "said"), (3, "why"), (4, "closed"))])
    rows = rows.select("stream_id", F.posexplode(parts).alias("nth", "q"))
    why = F.when(F.col("q.closed") != "", F.regexp_replace("q.why", r"^\s+|\s+$", ""))
    return rows.select("stream_id", (F.col("nth") + 1).cast("long").alias("nth"), F.regexp_extract("q.meta", r'"id"\s*:\s*"([^"]*)"', 1).alias("question_id"), F.col("q.said").alias("text"), why.alias("explanation"))


def strategies(outputs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``outputs`` (private: an analysis, the mark and JSON) but private, with fit_type and n_questions.

    Unknown types are empty, broken JSON asks nothing. A DECISION line goes before the JSON; where it changes the type to a high
    fit, nothing is asked."""
    marked = F.col("private").contains(STRATEGY)
    analysis = F.substring_index("private", STRATEGY, 1)
    raw = F.from_json(F.substring(F.col("private"), F.locate(STRATEGY, F.col("private")) + len(STRATEGY), F.length("private")), "fit_type string, questions array<string>", {"mode": "PERMISSIVE"})
    rows = outputs.withColumns({"told": F.when(marked, raw), "decided": F.regexp_extract(analysis, DECISION, 1)})
    said = F.when(F.col("told.fit_type").isin(*FITS), F.col("told.fit_type")).otherwise("")
    overridden = (F.col("decided") != "") & (F.col("decided") != said)
    n = F.when(overridden & (F.col("decided") == "high_fit"), 0).otherwise(F.coalesce(F.when(F.col("told.questions").isNotNull(), F.size("told.questions")), F.lit(0)))
    return rows.select(*[c for c in outputs.columns if c != "private"], F.when(overridden, F.col("decided")).otherwise(said).alias("fit_type"), n.cast("long").alias("n_questions"))


def analyses(texts: DataFrame) -> DataFrame:
    """stream_id, summary (empty without its mark), fit_type, n_questions of each whole output."""
    text = F.coalesce("text", F.lit(""))
    at = F.locate(SUMMARY, text)
    summary = F.when(at > 0, F.regexp_replace(F.substring(text, at + len(SUMMARY), F.length(text)), r"^\n+", "")).otherwise("")
    return strategies(texts.select("stream_id", summary.alias("summary"), F.substring_index(text, SUMMARY, 1).alias("private")))


def json_lines(texts: DataFrame) -> DataFrame:
    """stream_id, nth, line: the whole lines that are JSON objects, trimmed, before a line that is the end mark."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rows = texts.select("stream_id", lines.alias("lines"))
    end = F.array_position("lines", DONE)
    whole = F.slice("lines", F.lit(1), F.when(end > 0, end - 1).otherwise(F.size("lines") - 1).cast("int"))
    rows = rows.select("stream_id", F.posexplode(whole).alias("nth", "line"))
    return rows.where(F.col("line").startswith("{") & F.json_object_keys("line").isNotNull()).select("stream_id", (F.col("nth") + 1).cast("long").alias("nth"), "line")


def json_object(text: Column) -> Column:
    """The first JSON object of a model's answer as text: what a code fence holds, else the first braces that balance, else all from
    the first brace with the missing braces closed. Commas before a closing bracket go. Null if there is no object."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    source = F.when(text.rlike(r"(?s)```(?:json)?\s*(.*?)```"), fence).otherwise(text)
    begun = F.when(F.locate("{", source) > 0, F.substring(source, F.locate("{", source), F.length(source)))
    # the depth after each brace; the first zero ends the object
    steps = F.filter(F.transform(F.split(begun, ""), lambda c, i: F.struct(i.alias("i"), F.when(c == "{", 1).when(c == "}", -1).alias("d"))), lambda x: x["d"].isNotNull())
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("end"))
    told = F.aggregate(steps, start, lambda s, x: F.struct((s["depth"] + F.when(s["end"] < 0, x["d"]).otherwise(0)).alias("depth"), F.when((s["end"] < 0) & (s["depth"] + x["d"] == 0), x["i"]).otherwise(s["end"]).alias("end")))
    raw = F.when(told["end"] >= 0, F.substring(begun, F.lit(1), told["end"] + 1)).otherwise(F.concat(begun, F.repeat(F.lit("}"), told["depth"])))
    mended = F.regexp_replace(raw, r",\s*([}\]])", "$1")
    return F.when(F.json_object_keys(mended).isNotNull(), mended)
