"""Stream parsers: any cutting into chunks gives the batch form's rows."""

import random

import pytest
from pyspark.sql import functions as F

from matchweave.streaming import parsers

TEXTS = [
    'x [META]{"id": "a"}\nWhat?[EXPL] why \n[/EXPL][META] {"id": "b"}\nsecond [META] inside[EXPL]e[/EXPL][QUESTIONS_DONE][META]{"id": "z"}\nno',
    '[META]bad [META]{"id": "c"}\nopen text with [ and [EXP and [QUESTIONS_DON',
    '[META]{"id": "d"}\n[EXPL]never closed',
    '[META]{"id": "e"}\nends[QUESTIONS_DONE]',
    '[META]{"id": "f"} no line end',
    "",
    None,
    '[META]oops\n[META]{"id": "g"}\n\n[EXPL][/EXPL]tail',
]
OUTPUTS = [
    'private DECISION: high_fit\n###STRATEGY###{"fit_type": "niche_fit", "questions": ["a"]}###SUMMARY###\n\nHello ###SUMMARY### again',
    'private###STRATEGY###{"fit_type": "high_fit", "questions": ["a", "b"]}',
    'x###STRATEGY###{"fit_type": "low_fit", "questions": "no"}###SUMMARY###text',
    "only prose###SUMMARY###\n",
    'DECISION: niche_fit###STRATEGY###{broken###SUMMARY###s',
    None,
]


def cut(draw, text):
    out, at = [], 0
    while at < len(text):
        n = draw.choice((1, 2, 5, 17, 60))
        out.append(text[at : at + n])
        at += n
    return out or [""]


def fed(parser, chunks):
    """The parser's events, its state taken out and put back between chunks."""
    p, out = parser(), []
    for k, c in enumerate(chunks):
        p = parser(*p.state())
        out += list(p.feed(c, k == len(chunks) - 1))
    return out


def test_questions_under_any_cut(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "stream_id long, text string")
    want = {}
    for r in parsers.questions(df).collect():
        want.setdefault(r.stream_id, []).append((r.nth, r.text, r.explanation))
    assert len(want[0]) == 2 and want[0][1][1] == "second [META] inside" and want[2] == [(1, "", None)] and want[1][0][1].endswith("DON")
    draw = random.Random(1)
    for i, text in enumerate(TEXTS):
        for _ in range(40):
            told = {}
            for kind, nth, value in fed(parsers.Questions, cut(draw, text or "")):
                q = told.setdefault(nth, ["", None])
                if kind == "text":
                    q[0] += value
                elif kind == "close":
                    q[1] = value
            assert sorted((n, *q) for n, q in told.items()) == sorted(want.get(i, [])), (i, text)


def test_analyses_under_any_cut(spark):
    df = spark.createDataFrame(list(enumerate(OUTPUTS)), "stream_id long, text string")
    rows = {r.stream_id: r for r in parsers.analyses(df).collect()}
    assert [(rows[i].fit_type, rows[i].n_questions) for i in range(6)] == [("high_fit", 0), ("high_fit", 2), ("", 0), ("", 0), ("niche_fit", 0), ("", 0)]
    assert rows[0].summary == "Hello ###SUMMARY### again"
    draw = random.Random(2)
    for i, text in enumerate(OUTPUTS):
        for _ in range(30):
            events = fed(parsers.Analysis, cut(draw, text or ""))
            assert [v for k, _, v in events if k == "strategy"] == [(text or "").partition(parsers.SUMMARY)[0]]
            assert "".join(v for k, _, v in events if k == "text") == rows[i].summary


def test_lines_under_any_cut():
    draw, text = random.Random(3), "one\n\n two \nlast"
    for _ in range(20):
        assert [v for _, _, v in fed(parsers.Lines, cut(draw, text))] == ["one", "", " two "]


def test_json_lines(spark):
    df = spark.createDataFrame([(1, ' {"a": 1} \n\nx\n{bad\n[1]\n{"b": 2}\n{"c": 3}'), (2, '{"a": 1}\n [QUESTIONS_DONE] \n{"b": 1}\n'), (3, None)], "stream_id long, text string")
    assert sorted((r.stream_id, r.nth, r.line) for r in parsers.json_lines(df).collect()) == [(1, 1, '{"a": 1}'), (1, 6, '{"b": 2}'), (2, 1, '{"a": 1}')]


@pytest.mark.parametrize(
    ("text", "want"),
    [('say ```json\n{"a": 1}\n``` {"b": 2}', '{"a": 1}'), ('x {"a": {"b": 1}} y {"c": 2}', '{"a": {"b": 1}}'), ('{"a": {"b": [1, 2,],}', '{"a": {"b": [1, 2]}}'), ("[1, 2]", None), ("none", None), (None, None), ("", None), ("{a}", None)],
)
def test_json_object(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parsers.json_object(F.col("t")).alias("o")).collect()[0].o == want


def test_stream_equals_batch(spark, tmp_path):
    draw, rows = random.Random(4), []
    for i, text in enumerate(TEXTS):
        parts = cut(draw, text or "")
        rows += [(i, k, c, k == len(parts) - 1) for k, c in enumerate(parts)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, chunk string, last boolean")
    for k in range(3):  # three files, read one a batch
        df.where(F.floor(F.col("seq") / 4) == k if k < 2 else F.col("seq") >= 8).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = parsers.events_stream(stream, parsers.Questions).writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    told = spark.table("asked")
    opened = {(r.stream_id, r.nth) for r in told.where("kind = 'open'").collect()}
    closed = {(r.stream_id, r.nth, r.value) for r in told.where("kind = 'close'").collect()}
    want = parsers.questions(parsers.whole_texts(df)).collect()
    assert opened == {(r.stream_id, r.nth) for r in want} and closed == {(r.stream_id, r.nth, r.explanation) for r in want if r.explanation is not None}


def test_texts_are_cut_in_one_reading(spark):
    texts = ["", "a", "abcdefg", "abcdefgh", "אב\n\r\n😀x😀yz q" * 3]
    out = spark.createDataFrame([(t, k) for t in texts for k in (1, 3, 7)], "t string, k int").select("t", "k", parsers.cut(F.col("t"), F.col("k")).alias("c"))
    for r in out.collect():
        assert r.c == ([r.t[i : i + r.k] for i in range(0, len(r.t), r.k)] or [""])
    assert "substring" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [(1, 2, "c"), (1, 1, "b"), (1, 0, None), (1, None, "a"), (1, 2, "b"), (2, 0, None)]
    whole = parsers.whole_texts(spark.createDataFrame(rows, "stream_id long, seq int, chunk string"))
    assert sorted(map(tuple, whole.collect())) == [(1, "abbc"), (2, "")]
