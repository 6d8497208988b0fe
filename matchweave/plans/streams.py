"""Queries of the stream parsers over outputs made from whole documents, cut into chunks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.plans.inputs import dealt, table
from matchweave.plans.registry import query
from matchweave.streaming import parsers

#: SQL of the marked questions of a document, of its analysis and of its lines of JSON, the same for every engine.
ASKED = " || ".join((
    "'intro [META]{\"id\": \"q1\", \"doc\": ' || doc_id || '}' || chr(10) || coalesce(text, '') || '[EXPL] ' || coalesce(source, 'none') || chr(10) || ' [/EXPL]'",
    "CASE doc_id % 3 WHEN 0 THEN '[META]oops' || chr(10) || 'x' ELSE ' between ' END",
    "'[META] {\"id\": \"q2\"}' || chr(10) || coalesce(lang, 'no') || CASE doc_id % 4 WHEN 0 THEN '[EXPL]cut' WHEN 1 THEN '' ELSE '[EXPL]done[/EXPL]' END",
    "CASE doc_id % 5 WHEN 0 THEN '[QUESTIONS_DONE] tail [META]{\"id\": \"q9\"}' || chr(10) || 'never' ELSE '' END",
))
ANALYSED = " || ".join((
    "coalesce(source, '') || CASE doc_id % 3 WHEN 0 THEN ' DECISION: high_fit' WHEN 1 THEN chr(10) || 'DECISION:  niche_fit ' ELSE '' END",
    "CASE doc_id % 7 WHEN 0 THEN '' ELSE '###STRATEGY###{\"fit_type\": \"' || CASE doc_id % 4 WHEN 0 THEN 'high_fit' WHEN 1 THEN 'niche_fit' ELSE 'other' END || '\", \"questions\": ' || CASE doc_id % 5 WHEN 0 THEN '\"none\"' ELSE '[\"a\", \"b\", \"c\"]' END || CASE doc_id % 11 WHEN 0 THEN '' ELSE '}' END END",
    "CASE doc_id % 6 WHEN 0 THEN '' ELSE '###SUMMARY###' || chr(10) || chr(10) || coalesce(text, '') END",
))
LISTED = "' {\"id\": ' || doc_id || '} ' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '{\"id\": ' || CASE doc_id % 3 WHEN 0 THEN '' ELSE '2' END || '}' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '[QUESTIONS_DONE]' || chr(10) ELSE '' END || '{\"id\": 3}' || chr(10) || '{\"id\": 4}'"
ANSWERED = "CASE o_orderkey % 6 WHEN 0 THEN 'Sure: ```json' || chr(10) || '{\"a\": ' || o_orderkey || ',}```' WHEN 1 THEN 'x } {\"a\": {\"b\": [1, 2,], \"c\": {}}} {\"d\": 1}' WHEN 2 THEN '{\"k\": {\"m\": ' || o_custkey WHEN 3 THEN '[1, 2]' WHEN 4 THEN 'no {braces} at all' ELSE o_orderpriority END"


def _chunks(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """stream_id, seq, chunk: the whole text of each document's stream, cut every 7 to 15 characters.
    Documents are dealt by stream first, so the chunks, many times their bytes, are put together where they are cut."""
    rows = dealt(table(spark, sf_dir, "documents"), "doc_id").selectExpr("doc_id AS stream_id", f"{text} AS t", "CAST(7 + doc_id % 9 AS int) AS k")
    return rows.select("stream_id", F.posexplode(parsers.cut(F.col("t"), F.col("k"))).alias("seq", "chunk"))


@query("parse_questions", f"""WITH t AS (SELECT doc_id AS stream_id, split_part({ASKED}, '[QUESTIONS_DONE]', 1) AS t FROM documents),
p AS (SELECT stream_id, {", ".join(f"regexp_extract_all(t, '{parsers.QUESTION}', {k}) AS {n}" for k, n in ((1, "a"), (2, "b"), (3, "c"), (4, "d")))} FROM t),
q AS (SELECT stream_id, unnest(generate_series(1, len(a))) AS nth, unnest(a) AS a, unnest(b) AS b, unnest(c) AS c, unnest(d) AS d FROM p)
SELECT stream_id, nth, regexp_extract(a, '"id"\\s*:\\s*"([^"]*)"', 1) AS question_id, b AS text, CASE WHEN d <> '' THEN regexp_replace(c, '^\\s+|\\s+$', '', 'g') END AS explanation FROM q""")
def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.questions(parsers.whole_texts(_chunks(spark, sf_dir, ASKED)))


@query("parse_analyses", f"""WITH t AS (SELECT doc_id AS stream_id, {ANALYSED} AS t FROM documents),
s AS (SELECT stream_id, split_part(t, '###SUMMARY###', 1) AS private, CASE WHEN contains(t, '###SUMMARY###') THEN regexp_replace(t[strpos(t, '###SUMMARY###') + 13:], '^\\n+', '') ELSE '' END AS summary FROM t),
j AS (SELECT *, split_part(private, '###STRATEGY###', 2) AS j, regexp_extract(split_part(private, '###STRATEGY###', 1), 'DECISION:\\s*(high_fit|niche_fit)', 1) AS decided FROM s),
k AS (SELECT *, CASE WHEN json_valid(j) AND j->>'fit_type' IN ('high_fit', 'niche_fit') THEN j->>'fit_type' ELSE '' END AS said, CASE WHEN json_valid(j) AND json_type(j->'questions') = 'ARRAY' THEN json_array_length(j->'questions') ELSE 0 END AS n FROM j)
SELECT stream_id, summary, CASE WHEN decided <> '' THEN decided ELSE said END AS fit_type, (CASE WHEN decided = 'high_fit' AND said <> 'high_fit' THEN 0 ELSE n END)::BIGINT AS n_questions FROM k""")
def parse_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.analyses(parsers.whole_texts(_chunks(spark, sf_dir, ANALYSED)))


@query("parse_json_lines", f"""WITH t AS (SELECT doc_id AS stream_id, string_split({LISTED}, chr(10)) AS a FROM documents),
l AS (SELECT stream_id, unnest(generate_series(1, len(a))) AS nth, regexp_replace(unnest(a), '^\\s+|\\s+$', '', 'g') AS line, len(a) AS size FROM t),
e AS (SELECT stream_id, min(nth) FILTER (line = '[QUESTIONS_DONE]') AS stop FROM l GROUP BY 1)
SELECT stream_id, nth, line FROM l JOIN e USING (stream_id) WHERE nth < coalesce(stop, size) AND starts_with(line, '{{') AND json_valid(line)""")
def parse_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.json_lines(parsers.whole_texts(_chunks(spark, sf_dir, LISTED)))


@query("parse_json_objects", f"""WITH t AS (SELECT o_orderkey AS id, {ANSWERED} AS t FROM orders),
s AS (SELECT id, CASE WHEN regexp_matches(t, '(?s)```(?:json)?\\s*(.*?)```') THEN regexp_extract(t, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE t END AS t FROM t),
b AS (SELECT id, t[strpos(t, '{{'):] AS t FROM s WHERE contains(t, '{{')),
c AS (SELECT id, t, unnest(generate_series(1, len(t))) AS i, unnest(string_split(t, '')) AS ch FROM b),
d AS (SELECT id, t, i, sum((ch = '{{')::INT - (ch = '}}')::INT) OVER (PARTITION BY id ORDER BY i) AS depth FROM c),
f AS (SELECT id, any_value(t) AS t, min(i) FILTER (depth = 0) AS stop, arg_max(depth, i) AS rest FROM d GROUP BY id),
r AS (SELECT id, regexp_replace(CASE WHEN stop IS NULL THEN t || repeat('}}', rest::INT) ELSE t[:stop] END, ',\\s*([}}\\]])', '\\1', 'g') AS raw FROM f)
SELECT id, CASE WHEN json_valid(raw) THEN raw END AS object, CASE WHEN json_valid(raw) THEN array_to_string(json_keys(raw), '|') END AS names FROM t LEFT JOIN r USING (id)""")
def parse_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{ANSWERED} AS t")
    return rows.select("id", parsers.json_object(F.col("t")).alias("object")).withColumn("names", F.array_join(F.json_object_keys("object"), "|"))
