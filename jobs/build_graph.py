"""Batch job: a folder of documents becomes a property graph of chunks, entities and relationships, as partitioned tables.

    python -m jobs.build_graph --documents s3a://.../documents --output s3a://.../graph [--config jobs/build_graph.json]

Reads documents (doc_id, text; more columns are not read). Writes

    nodes/node_type=...   node_id, text (of a chunk), n_chunks and n_docs that mention it (of an entity)
    edges/type=...        source, target, confidence, context, chunk_id, n (times that a chunk mentions an entity)
    statistics            kind, type, n, as JSON lines

Config: sentences_in_chunk and sentences_shared (by neighbouring chunks); min_chunks: entities that fewer chunks mention become no
nodes and get no MENTIONS edges.

A run writes every table anew, so a run that ends halfway is mended by the next one, and the same documents give the same graph in
any order and number of files. Rows equal in id and text give the same chunks, which are kept once; other texts of the same id are
chunks of their own. Documents without words have no chunks; a null id reads `null`.

Texts are written once, as the graph's nodes, by the tasks that read them; only documents whose id comes again have their chunks shuffled. Entities and
relationships are found in what is written. Entities are counted in their chunk and before they are shuffled, so neither a frequent entity nor a long
document is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, described, log
from skeinwork.functions.storage import cut, scope
from skeinwork.operators import chunking, entities, graph, relations

NODES = "node_id string, text string, n_chunks long, n_docs long, node_type string"
EDGES = "source string, target string, confidence double, context string, chunk_id string, n long, type string"
CONFIG = {"sentences_in_chunk": 3, "sentences_shared": 1, "min_chunks": 1}


def chunks_of(docs: DataFrame, in_chunk: int, shared: int) -> DataFrame:
    """chunk_id, source_doc, ord, text: runs of sentences, each once. Ids are the document's, the number of the chunk and a hash of its text."""
    doc = F.lpad(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 20, "0")
    docs = docs.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # chunks can be equal only where a document's id comes again
    again = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "graph-again")

    def runs(of: DataFrame) -> DataFrame:
        key = F.concat("doc_id", F.lit("#"), F.lpad(F.col("chunk_index").cast("string"), 8, "0"), F.lit("#"), F.substring(F.sha2("text", 256), 1, 12))
        return chunking.sentences(of, in_chunk, shared).select(key.alias("chunk_id"), F.col("doc_id").alias("source_doc"), key.alias("ord"), "text")

    if again.isEmpty():
        return runs(docs)
    return runs(docs.join(again, "doc_id", "left_anti")).union(runs(docs.join(again, "doc_id", "left_semi")).dropDuplicates(["chunk_id"]))


def run(spark: SparkSession, documents: str, output: str, config: dict | None = None) -> DataFrame:
    """Builds the graph of the documents; returns what `stored` reads of it."""
    chosen = {**CONFIG, **(config or {})}
    docs = described(spark.read.parquet(documents), "read documents", documents)
    with scope(spark):
        chunks = chunks_of(docs, chosen["sentences_in_chunk"], chosen["sentences_shared"])
        kept = graph.chunk_nodes(chunks).select("node_id", "node_type", F.col("full_text").alias("text"))
        absent = F.lit(None).cast("long")
        kept.select("node_id", "text", absent.alias("n_chunks"), absent.alias("n_docs"), "node_type").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("node_type").parquet(f"{output}/nodes")
        own = spark.read.schema(NODES).parquet(f"{output}/nodes").where("node_type = 'CHUNK'")
        chunks = own.select(F.col("node_id").alias("chunk_id"), F.lit(None).cast("string").alias("source_doc"), F.col("node_id").alias("ord"), "text")
        # one edge for each chunk and entity
        found = entities.keyword_counts(chunks)
        mentions = cut(found.select(F.col("chunk_id").alias("source"), F.col("text").alias("target"), F.col("type").alias("entity_type"), "n", "confidence"), "graph-mentions")
        doc = F.regexp_extract("source", "^([^#]*)#", 1)
        of_doc = mentions.groupBy("target", "entity_type", doc.alias("doc")).agg(F.count("*").alias("n"))
        names = of_doc.groupBy("target", "entity_type").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_docs")).where(F.col("n_chunks") >= chosen["min_chunks"])
        names = cut(names, "graph-names")
        if chosen["min_chunks"] > 1:
            mentions = mentions.join(names.select("target", "entity_type"), ["target", "entity_type"], "left_semi")
        none = F.lit(None).cast("string")
        nodes = names.select(F.col("target").alias("node_id"), none.alias("text"), "n_chunks", "n_docs", F.col("entity_type").alias("node_type"))
        edges = mentions.select("source", "target", F.lit("MENTIONS").alias("type"), "confidence", none.alias("context"), F.col("source").alias("chunk_id"), "n")
        said = graph.relation_edges(relations.dedup(relations.pattern_relations(chunks))).select("source", "target", "type", "confidence", "context", "chunk_id")
        nodes.hint("rebalance", "node_type").write.mode("append").partitionBy("node_type").parquet(f"{output}/nodes")
        # mentions are of one type and lie in parts of like size, so they need no sort by it; what is of several types is dealt to such, whichever is frequent
        edges.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("type").parquet(f"{output}/edges")
        said.withColumn("n", F.lit(None).cast("long")).hint("rebalance", "type").write.mode("append").partitionBy("type").parquet(f"{output}/edges")
    nodes, edges = tables(spark, output)
    described(nodes, "wrote nodes", f"{output}/nodes")
    described(edges, "wrote edges", f"{output}/edges")
    counts = nodes.groupBy(F.lit("nodes").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    counts = counts.union(edges.groupBy(F.lit("edges").alias("kind"), "type").agg(F.count("*").alias("n")))
    counts.coalesce(1).write.mode("overwrite").json(f"{output}/statistics")  # a row for each type
    for r in spark.read.schema("kind string, type string, n long").json(f"{output}/statistics").orderBy("kind", "type").collect():
        log.info("graph has %d %s of type %s", r["n"], r["kind"], r["type"])
    return stored(spark, output)


def tables(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The stored nodes and edges; an empty graph has no files that could tell their columns."""
    return spark.read.schema(NODES).parquet(f"{output}/nodes"), spark.read.schema(EDGES).parquet(f"{output}/edges")


def stored(spark: SparkSession, output: str) -> DataFrame:
    """part (node or edge), type, source (of a node its id), target, confidence, n (of an entity its chunks), n_docs, text (of an edge its context)."""
    none = F.lit(None)
    nodes, edges = tables(spark, output)
    nodes = nodes.select(F.lit("node").alias("part"), F.col("node_type").alias("type"), F.col("node_id").alias("source"), none.cast("string").alias("target"), none.cast("double").alias("confidence"), F.col("n_chunks").alias("n"), "n_docs", "text")
    edges = edges.select(F.lit("edge").alias("part"), "type", "source", "target", "confidence", "n", none.cast("long").alias("n_docs"), F.col("context").alias("text"))
    return nodes.union(edges)


if __name__ == "__main__":
    command_line("build_graph", ["documents", "output"], "jobs/build_graph.json", run)
