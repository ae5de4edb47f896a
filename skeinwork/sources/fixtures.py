"""Inputs of the specification's shapes, derived from the test tables. The SQL is common to Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "conversations")

#: What each supplier supplies: its brands, with the least of their types.
SUPPLIED = """SELECT s_suppkey, s_name, p_brand, min(p_type) AS p_type
  FROM {lineitem} lineitem JOIN {part} part ON l_partkey = p_partkey JOIN {supplier} supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, p_brand"""

_ER_ROWS = """
SELECT 'a' || lpad(CAST(c_custkey AS VARCHAR(20)), 12, '0') AS ord, c_name AS source, 'based in' AS relation, n_name AS target, 'entity' AS target_type,
  c_mktsegment AS section, CAST(NULL AS VARCHAR(20)) AS year, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR(40)) AS value, 'USD' AS unit, CAST(NULL AS VARCHAR(200)) AS evidence_note
FROM {customer} customer JOIN {nation} nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'b' || lpad(CAST(n_nationkey AS VARCHAR(20)), 12, '0'), n_name, 'part of', r_name, 'entity', 'GEOGRAPHY', NULL, NULL, NULL, NULL
FROM {nation} nation JOIN {region} region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || lpad(CAST(o_orderkey AS VARCHAR(20)), 12, '0'), c_name, 'placed', 'Order ' || CAST(o_orderkey AS VARCHAR(20)), 'data', o_orderpriority,
  CAST(extract(year FROM o_orderdate) AS VARCHAR(10)) || '.0', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(40)), 'USD', NULL
FROM {orders} orders JOIN {customer} customer ON o_custkey = c_custkey
UNION ALL SELECT 'd' || lpad(CAST(s_suppkey AS VARCHAR(20)), 12, '0') || '/' || p_brand, s_name, 'supplies', p_brand, 'concept', p_type, NULL, NULL, NULL,
  'Steel Works and Iron ' || p_brand || ' grew ~12.5% to rank #1, then 7% in Main Street'
FROM ({supplied}) x
"""

#: Entity-relation rows, all text: ord is unique and orders them.
ER_ROWS = _ER_ROWS.replace("{supplied}", SUPPLIED)

#: Subjective-section rows from documents.
SS_ROWS = """
SELECT lpad(CAST(d.doc_id AS VARCHAR(20)), 12, '0') AS ord, source AS section, source || '/' || lang AS subsection, CAST(2018 + d.doc_id % 6 AS VARCHAR(10)) || '.0' AS year,
  CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'poor' END AS perspective, text AS content, lang || ', ' || source AS tags
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: Chunks of text from documents and conversations.
TEXT_CHUNKS = """
SELECT 'doc_' || CAST(doc_id AS VARCHAR(20)) AS chunk_id, source AS source_doc, 'd' || lpad(CAST(doc_id AS VARCHAR(20)), 12, '0') AS ord, text FROM {documents} documents
UNION ALL SELECT 'conv_' || CAST(conv_id AS VARCHAR(20)) || '_' || CAST(turn AS VARCHAR(20)), role,
  'e' || lpad(CAST(conv_id AS VARCHAR(20)), 12, '0') || '/' || lpad(CAST(turn AS VARCHAR(20)), 6, '0'), text FROM {conversations} conversations
"""

QUESTIONS = (
    (0, "What is Customer Corporation's revenue in 2023?"), (1, "How is NATION related to Region One?"), (2, "Compare revenue across different products"),
    (3, "Digital transformation initiatives"), (4, 'List the main products of "Supplier#000000001"'), (5, "How is \"Customer#000000001\" structured?"),
    (6, "Who is \"NATION_3\"?"), (7, "Explain the relationship between \"NATION_1\" and \"AFRICA\""), (8, "What was the total of sales during last year?"),
    (9, "When did online Growth begin?"), (10, "Show the timeline of Brand Line 2021 and 2022"), (11, "difference between Steel Works and Iron"),
    (12, "how many orders did \"Customer#000000002\" place in 1998"), (13, "Define profit for the latest firm"), (14, "recent business news"),
    (15, "connection between \"Supplier#000000002\" and \"Brand#2\""), (16, "Average performance versus previous year"), (17, "link between \"ASIA\" and \"NATION_2\" in 2024"),
    (18, "what is the sum"), (19, ""),
)

#: Questions that grow with the tables: of every shape about customers and their years, and what users ask in conversations.
ASKED = """
SELECT c_custkey AS query_id, CASE CAST(c_custkey % 12 AS INT)
  WHEN 0 THEN 'What is "' || c_name || '" worth in ' || CAST(2019 + c_custkey % 7 AS VARCHAR(10)) || '?'
  WHEN 1 THEN 'How is ' || c_mktsegment || ' related to "' || c_name || '"?' WHEN 2 THEN 'Compare revenue of "' || c_name || '" across different products'
  WHEN 3 THEN 'What was the total of sales to "' || c_name || '" during last year?' WHEN 4 THEN 'When did online Growth of ' || lower(c_mktsegment) || ' begin?'
  WHEN 5 THEN 'Who is "' || c_name || '" and what is "NATION_' || CAST(c_nationkey AS VARCHAR(10)) || '"' WHEN 6 THEN 'how many orders did ' || c_name || ' place in 1998'
  WHEN 7 THEN 'Define profit for the latest firm, versus previous year' WHEN 8 THEN 'recent business news of Steel Works and Steel Works'
  WHEN 9 THEN 'link between "' || c_name || '" and "' || c_name || '" in 2024 and 2024' WHEN 10 THEN 'Show the timeline of Brand Line 2021 and 2022' ELSE '' END AS question FROM {customer} customer
UNION ALL SELECT -1 - 1000 * conv_id - turn, text FROM {conversations} conversations WHERE role = 'user' AND text IS NOT NULL
"""

#: Answers of a model about customers: good lines, lines that lack a field, have a bad score, more fields, another prefix, or no lines.
ANSWERED = """
SELECT 'r' || CAST(c_custkey AS VARCHAR(20)) AS chunk_id, 'ENTITY: ' || c_name || ' | TYPE: ' || lower(c_mktsegment) || ' | CONFIDENCE: 0.' || CAST(1 + c_custkey % 9 AS VARCHAR(10)) || chr(10) || CASE CAST(c_custkey % 6 AS INT)
  WHEN 0 THEN 'Some words' || chr(10) || 'ENTITY: Only two | TYPE: X' WHEN 1 THEN '  ENTITY: Spaced ' || c_name || ' | TYPE: concept | CONFIDENCE: high'
  WHEN 2 THEN 'ENTITY: Extra | TYPE: metric | CONFIDENCE: 0.5 | NOTE: x' WHEN 3 THEN 'entity: lower | TYPE: X | CONFIDENCE: 1' WHEN 4 THEN '' ELSE 'ENTITY: Last | TYPE: year | CONFIDENCE: 1e-1' END AS response FROM {customer} customer
"""

RESPONSES = (
    ("r0", "ENTITY: Acme Corp | TYPE: organization | CONFIDENCE: 0.9\nENTITY: Jakarta | TYPE: Location | CONFIDENCE: 1.0"),
    ("r1", "Some words\nENTITY: Only two | TYPE: X"),
    ("r2", "  ENTITY: Spaced Out | TYPE: concept | CONFIDENCE: high\nENTITY: Extra | TYPE: metric | CONFIDENCE: 0.5 | NOTE: x"),
    ("r3", "entity: lower | TYPE: X | CONFIDENCE: 1"), ("r4", ""), ("r5", "ENTITY: Last | TYPE: year | CONFIDENCE: 1e-1"),
)

#: Loop, parallel edges, cycle, dangling end, and one name under two types.
GRAPH_EDGES = (
    ("e1", "A", "B", "KNOWS"), ("e2", "A", "B", "KNOWS"), ("e3", "B", "C", "LIKES"), ("e4", "C", "A", "LIKES"), ("e5", "C", "C", "SELF"),
    ("e6", "C", "D", "HAS"), ("e7", "D", "E", "HAS"), ("e8", "E", "Ghost", "HAS"), ("e9", "F", "G", "PART OF"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    names = [n for n in TABLES if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}, **more)


def duck(text: str) -> str:
    """The same SQL over views of the tables' names."""
    for n in TABLES:
        text = text.replace("{" + n + "}", n)
    return text


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of SUPPLIED. Suppliers are joined with their brands, not with each line, so lines are neither shuffled for them nor sorted with their names."""
    of = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    least = of.groupBy("l_suppkey", "p_brand").agg(F.min("p_type").alias("p_type"))
    named = least.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    # a key that stands twice under a name is one supplier
    return named.groupBy("s_suppkey", "s_name", "p_brand").agg(F.min("p_type").alias("p_type"))


def er_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ER_ROWS."""
    text = f"SELECT 'er_' || ord AS chunk_id, 'er.csv' AS source_doc, * FROM ({_ER_ROWS.replace('({supplied})', '{supplied}')}) r"
    return derive(spark, sf_dir, text, supplied=supplied(spark, sf_dir))


def ss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, f"SELECT 'ss_' || ord AS chunk_id, 'ss.csv' AS source_doc, * FROM ({SS_ROWS}) r")


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TEXT_CHUNKS)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id long, question string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ASKED)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, f"SELECT chunk_id, 'model' AS source_doc, chunk_id AS ord, response FROM ({ANSWERED}) r")


def graph_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*e, e[0]) for e in GRAPH_EDGES], "edge_id string, source string, target string, type string, ord string")


NODE_VECTORS = "SELECT vec_id, embedding, 'L' || CAST(label AS VARCHAR(10)) AS node_type, 'Vec ' || CAST(vec_id AS VARCHAR(20)) AS entity_name FROM {embeddings} embeddings"
EDGE_VECTORS = """SELECT vec_id, embedding, 'Vec ' || CAST(vec_id AS VARCHAR(20)) AS source, 'Vec ' || CAST(vec_id + 1 AS VARCHAR(20)) AS target, 'NEXT_L' || CAST(label AS VARCHAR(10)) AS relationship_type,
  CAST(2018 + vec_id % 8 AS VARCHAR(10)) AS year, 'part ' || CAST(vec_id % 7 AS VARCHAR(10)) AS section FROM {embeddings} embeddings"""
#: Every twentieth vector asks, about names and types that are there.
VECTOR_QUESTIONS = """SELECT vec_id AS query_id, embedding AS query, 'Question ' || CAST(vec_id AS VARCHAR(20)) AS question, CASE WHEN vec_id % 60 = 0 THEN 'L' || CAST(label AS VARCHAR(10)) END AS node_type_filter,
  'Vec ' || CAST(vec_id + 5 AS VARCHAR(20)) AS name1, 'Vec ' || CAST(vec_id AS VARCHAR(20)) AS name2, CAST(2018 + vec_id % 8 AS VARCHAR(10)) AS year1 FROM {embeddings} embeddings WHERE vec_id % 20 = 0"""


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = derive(spark, sf_dir, VECTOR_QUESTIONS)
    return q.select("query_id", "query", "question", "node_type_filter", F.array("name1", "name2").alias("entities"), F.array("year1").alias("temporal"))
