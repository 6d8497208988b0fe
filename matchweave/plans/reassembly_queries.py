"""The query of documents put together again from accepted and rejected changes, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchweave.operators import documents_cv
from matchweave.plans.inputs import table
from matchweave.plans.registry import query

#: SQL of the units of an order's document, the same for every engine.
_UNITS = (
    "l_orderkey AS doc_id", "l_linenumber AS unit_order", "l_partkey * 1000000 + l_suppkey AS unit_id", "CASE l_partkey % 3 WHEN 0 THEN 'role_header' WHEN 1 THEN 'bullet' ELSE 'section' END AS unit_type",
    "l_suppkey % 4 > 0 AS changed", "CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS approved",
    "CASE l_suppkey % 6 WHEN 0 THEN ' a ' WHEN 1 THEN NULL ELSE '  was ' || l_partkey || ' ' END AS original_text", "CASE l_suppkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE ' is ' || l_suppkey END AS updated_text",
)


@query("cv_reassembled", f"""WITH u AS (SELECT {", ".join(_UNITS)} FROM lineitem), t AS (SELECT *, trim(coalesce(original_text, '')) AS o, trim(coalesce(updated_text, '')) AS n FROM u),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit_order, unit_id) AS unit_order, unit_type, CASE WHEN changed AND approved IS NOT DISTINCT FROM false AND len(o) > 2 THEN o ELSE n END AS line FROM t),
h AS (SELECT doc_id, min(unit_order) AS first FROM l WHERE unit_type = 'role_header' AND line <> '' GROUP BY 1)
SELECT doc_id, coalesce(string_agg(CASE unit_type WHEN 'role_header' THEN CASE WHEN unit_order > first THEN chr(10) ELSE '' END || line WHEN 'bullet' THEN '$ ' || line ELSE line END, chr(10) ORDER BY unit_order) FILTER (line <> ''), '') AS text, count(*) FILTER (line <> '') AS n_units
FROM l LEFT JOIN h USING (doc_id) GROUP BY doc_id""")
def cv_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_cv.reassembled(table(spark, sf_dir, "lineitem").selectExpr(*_UNITS))
