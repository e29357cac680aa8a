"""The star-schema test tables as documents, pages, facts and model responses.

FACTS, PAGES and RESPONSES are plain SQL that Spark and other engines read alike; {table} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.identity import content_hash

LINES_A_PAGE = 8
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

DOCS = "SELECT CAST(doc_id AS STRING) AS doc_id, source || '/' || CAST(doc_id AS STRING) AS filename, coalesce(text, '') AS text FROM {documents}"

FACTS = """
WITH r AS (
  SELECT l_suppkey AS s, year(l_shipdate) AS y,
         sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS f,
         sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS o
  FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate)),
k AS (
  SELECT s, y, 1 AS n, 'revenue finalised' AS metric, CAST(f AS STRING) AS v FROM r UNION ALL
  SELECT s, y, 2, 'revenue open', CAST(o AS STRING) FROM r UNION ALL
  SELECT s, y, 3, 'total revenue', '₹' || CAST(f + o AS STRING) FROM r),
a AS (
  SELECT 'R' || CAST(s AS STRING) || '-' || CAST(y AS STRING) || '-' || CAST(n AS STRING) AS id, 'ledger-' || CAST(y AS STRING) AS doc_id,
         'Supplier#' || CAST(s AS STRING) || ' Limited' AS entity, metric, 'numeric' AS fact_type, v AS value, 'INR' AS unit,
         'FY' || CAST(y - 1980 AS STRING) AS period_label, CAST(NULL AS STRING) AS basis,
         'the ' || metric || ' of supplier ' || CAST(s AS STRING) || ' was ' || v AS quote, CAST(1 + s % 5 AS INT) AS page_number,
         CAST(s * 1000000 + y * 100 + n * 10 AS BIGINT) AS fact_seq
  FROM k),
l AS (SELECT l_orderkey AS lk, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS total FROM {lineitem} GROUP BY l_orderkey),
o AS (
  SELECT o_orderkey AS ok, CAST(o_totalprice AS DECIMAL(18, 2)) AS price, total, CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'FY' || CAST(year(o_orderdate) - 1980 AS STRING) END AS period
  FROM {orders} JOIN l ON o_orderkey = lk),
b AS (
  SELECT ok, 0 AS n, 'orders' AS doc_id, CAST(price AS STRING) AS v, period, CASE WHEN ok % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'gross' END AS basis FROM o UNION ALL
  SELECT ok, 1, 'lines', CASE WHEN ok % 5 = 0 THEN CAST(price AS STRING) ELSE CAST(total AS STRING) END, period, CASE ok % 3 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'Gross' ELSE 'net' END FROM o),
c AS (
  SELECT c_custkey AS ck, 0 AS n, 'crm' AS doc_id, c_name, c_mktsegment AS v FROM {customer} UNION ALL
  SELECT c_custkey, 1, 'billing', c_name, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) || ' segment' ELSE 'unassigned' END FROM {customer}),
every AS (
  SELECT * FROM a UNION ALL
  SELECT id || '-d', doc_id, entity, metric, fact_type, value, unit, period_label, basis, 'as stated, ' || quote, page_number, fact_seq + 5 FROM a WHERE fact_seq % 4 = 0 UNION ALL
  SELECT 'O' || CAST(ok AS STRING) || '-' || CAST(n AS STRING), doc_id, 'Order ' || CAST(ok AS STRING) || ' Ltd', 'order price paid', 'numeric', v, CAST(NULL AS STRING), period, basis,
         'order ' || CAST(ok AS STRING) || ' came to ' || v, CAST(1 + ok % 9 AS INT), CAST(1000000000000 + ok * 10 + n AS BIGINT) FROM b UNION ALL
  SELECT 'C' || CAST(ck AS STRING) || '-' || CAST(n AS STRING), doc_id, c_name, 'market segment', 'semantic', v, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
         c_name || ' belongs to ' || v, CAST(1 + ck % 9 AS INT), CAST(2000000000000 + ck * 10 + n AS BIGINT) FROM c)
SELECT id, doc_id, doc_id || ':0' AS chunk_id, entity, metric, fact_type, value, unit, period_label, basis, CAST(NULL AS STRING) AS status, quote,
       CAST(0.5 AS DOUBLE) AS confidence, page_number, CAST(NULL AS STRING) AS printed_page, fact_seq
FROM every
"""

RESPONSES = """
SELECT CAST(o_orderkey AS STRING) AS chunk_id, 'orders' AS doc_id,
  CASE o_orderkey % 10
    WHEN 0 THEN 'Here you are: [] and no more'
    WHEN 1 THEN '```json' || chr(10) || '[{"entity": "Order ' || CAST(o_orderkey AS STRING) || '", "metric": "total", "fact_type": "Numeric", "value": "' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) || '", "quote": "the order came to a sum", "page": 3}]' || chr(10) || '```'
    WHEN 2 THEN '[{"entity": "Order ' || CAST(o_orderkey AS STRING) || '", "metric": "status", "fact_type": "semantic", "value": 17, "quote": "the status is stated here", "confidence": 1.5}]'
    WHEN 3 THEN '[{"entity": " ", "metric": "x", "fact_type": "numeric", "quote": "long enough a quote"}, {"entity": "B", "metric": "x", "fact_type": "odd", "quote": "long enough a quote"}]'
    WHEN 4 THEN '{"entity": "not a list"}'
    WHEN 5 THEN '[{"entity": "cut off", "metric": '
    WHEN 6 THEN 'I found nothing of note.'
    WHEN 7 THEN '[{"entity": "Q", "metric": "x", "fact_type": "numeric", "quote": "short"}, 5]'
    WHEN 8 THEN '[{"entity": "Order ' || CAST(o_orderkey AS STRING) || '", "metric": "priority", "fact_type": "semantic", "value": "' || o_orderpriority || '", "quote": "the priority of the order", "confidence": "0.75"}]'
    ELSE '[1][2]' END AS response_text
FROM {orders}
"""


def for_spark(sql: str, sf_dir: str) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql)


def for_duckdb(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(FACTS, sf_dir))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(RESPONSES, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, text, content_hash; the text stands for a file's content."""
    return spark.sql(for_spark(DOCS, sf_dir)).withColumn("content_hash", content_hash(F.col("text")))


def pages(spark: SparkSession, sf_dir: str, lines: int = LINES_A_PAGE) -> DataFrame:
    """doc_id, page_number, text, printed_page: a page for every eight lines."""
    docs = files(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("all"))
    numbered = docs.select("doc_id", "all", F.explode(F.sequence(F.lit(1), F.ceil(F.size("all") / lines).cast("int"))).alias("page_number"))
    text = F.array_join(F.slice("all", (F.col("page_number") - 1) * lines + 1, F.lit(lines)), "\n")
    return numbered.select("doc_id", "page_number", F.lit(None).cast("string").alias("printed_page"), text.alias("text"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with page numbers printed on them, made from orders: a document for each 40 orders, some two pages a sheet."""
    return spark.sql(for_spark(SHELF, sf_dir))


SHELF = """
SELECT doc_id, page_number, CASE WHEN page_number % 11 = 0 THEN 'Report ' || CAST(2024 AS STRING) || chr(10) || 'no number here'
  WHEN d % 3 = 2 THEN CAST(2 * page_number + 8 AS STRING) || '    ' || CAST(2 * page_number + 9 AS STRING) || chr(10) || 'Annual report 2024' || chr(10) || 'total ' || CAST(amount AS STRING)
  ELSE 'Annual report 2024' || chr(10) || 'total ' || CAST(amount AS STRING) || chr(10) || CAST(page_number + 5 + d % 3 AS STRING) END AS text
FROM (SELECT CAST(floor((o_orderkey - 1) / 40) AS BIGINT) AS d, 'shelf-' || CAST(CAST(floor((o_orderkey - 1) / 40) AS BIGINT) AS STRING) AS doc_id,
             CAST((o_orderkey - 1) % 40 + 1 AS INT) AS page_number, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM {orders}) x
"""


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = facts(spark, sf_dir)
    return have.select(*have.columns, F.lit("{}").alias("dimensions"), F.lit(S.PROMPT_VERSION).alias("prompt_version"))
