"""The engine's jobs from files to answers: build a graph, index it, retrieve, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.config import EngineConfig
from skeinwork.functions.storage import cut
from skeinwork.operators import answers, chunking, context, embedding, graph, questions, retrieval, vectors
from skeinwork.operators import entities as E
from skeinwork.operators import relations as R
from skeinwork.sources import files, tables


@dataclass(frozen=True)
class Built:
    entities: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame


def table_chunks(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, list[str]]:
    """A CSV file's rows with chunk_id, source_doc and ord, and its columns. Ids are the file's name and the row's number."""
    rows = files.csv_rows(spark, path, header)
    names = [c for c in rows.columns if c not in ("source_doc", "row_index")]
    number = F.lpad(F.col("row_index").cast("string"), 12, "0")
    return rows.withColumns({"chunk_id": F.concat("source_doc", F.lit("#"), number), "ord": F.concat("source_doc", F.lit("#"), number)}).drop("row_index"), names


def text_chunks(docs: DataFrame, config: EngineConfig) -> DataFrame:
    """Documents (doc_id, content) as chunks of the configured strategy."""
    own = docs.select("doc_id", F.col("content").alias("text"))
    if config.chunk_strategy == "sentence":
        cut_up = chunking.sentences(own)
    elif config.chunk_strategy == "semantic":
        cut_up = chunking.semantic(own)
    else:
        cut_up = chunking.fixed_size(own, config.chunk_size, config.chunk_overlap)
    # windows of a long paragraph count from 0 again: the place in the text tells them apart
    key = F.concat("doc_id", F.lit("#"), F.lpad(F.col("chunk_index").cast("string"), 8, "0"), F.lit("#"), F.substring(F.sha2("text", 256), 1, 12))
    return cut_up.select(key.alias("chunk_id"), F.col("doc_id").alias("source_doc"), key.alias("ord"), "text", "chunk_type")


def build_from_table(spark: SparkSession, path: str, header: bool = True, key_column: str | None = None) -> Built:
    rows, names = table_chunks(spark, path, header)
    own = cut(E.dedup(E.row_entities(rows, names, [key_column] if key_column else None)), "entities")
    relations = cut(R.dedup(R.table_relations(rows, own, names, key_column)), "relations")
    edges = graph.relation_edges(relations).withColumn("edge_id", F.col("ord"))
    return Built(own, relations, graph.entity_nodes(own), edges)


def build_from_texts(docs: DataFrame, config: EngineConfig = EngineConfig(chunk_strategy="fixed")) -> Built:
    """Keyword entities, with co-occurrence and pattern relationships, of documents' chunks."""
    chunks = cut(text_chunks(docs, config), "chunks")
    found = E.keyword_entities(chunks)
    near = R.cooccurrence(chunks, found, config.window_size, config.min_confidence)
    relations = cut(R.dedup(near.unionByName(R.pattern_relations(chunks), allowMissingColumns=True)), "relations")
    own = cut(E.dedup(found.withColumns({"column": F.lit(None).cast("string")})), "entities")
    nodes, edges = graph.build(chunks, own, relations)
    return Built(own, relations, nodes, edges.withColumn("edge_id", F.coalesce("ord", F.concat_ws("_", "source", "type", "target"))))


def write_summary(built: Built, folder: str) -> None:
    """Entities, relationships, counts by type, five samples of each type and graph totals, as JSON."""
    tables.write_json(built.entities, f"{folder}/entities")
    tables.write_json(built.relations, f"{folder}/relationships")
    tables.write_json_list(E.summary(built.entities).orderBy("type"), f"{folder}/entity_summary.json")
    tables.write_json(E.samples(built.entities), f"{folder}/entity_samples")
    tables.write_json_list(graph.statistics(built.entities, built.edges).orderBy("kind", "name"), f"{folder}/graph_statistics.json")


def index_graph(nodes: DataFrame, edges: DataFrame, embedder: embedding.Embedder, folder: str, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors of nodes and edges, from the folder if they are there, else made and stored. Ids follow the order of names."""
    spark = nodes.sparkSession
    stored = tables.load_vectors(spark, f"{folder}/node_vectors"), tables.load_vectors(spark, f"{folder}/edge_vectors")
    if stored[0] is not None and stored[1] is not None:
        return stored
    n, e = graph.for_indexing(nodes, edges, node_types, edge_types)
    for c in ("section", "year", "unit", "evidence"):
        n = n if c in n.columns else n.withColumn(c, F.lit(None).cast("string"))
        e = e if c in e.columns else e.withColumn(c, F.lit(None).cast("string"))
    # what texts are made of; numbered range by range: no id stands for two names, and no task numbers all rows
    n = vectors.numbered(n.select("node_id", "node_type", "name", *embedding.NODE, "evidence"), "node_id", "vec_id")
    e = vectors.numbered(e.select("ord", "source", "type", "target", "section", "year", "evidence"), "ord", "vec_id")
    n = embedding.embed_nodes(n, embedder).select("vec_id", "node_id", "node_type", F.col("name").alias("entity_name"), "text", "embedding")
    e = embedding.embed_edges(e, embedder).select("vec_id", "edge_id", "source", "target", F.col("type").alias("relationship_type"), "year", "section", "evidence", "text", "embedding")
    tables.save_vectors(n, f"{folder}/node_vectors")
    tables.save_vectors(e, f"{folder}/edge_vectors")
    return tables.load_vectors(spark, f"{folder}/node_vectors"), tables.load_vectors(spark, f"{folder}/edge_vectors")


def hybrid_statistics(node_vectors: DataFrame | None, edge_vectors: DataFrame | None) -> dict:
    """Whether the vector stores are there, and what they hold."""
    out = {"indexed": node_vectors is not None and edge_vectors is not None}
    for name, store in (("node_store", node_vectors), ("edge_store", edge_vectors)):
        out[name] = vectors.statistics(store).first().asDict() if store is not None else None
    return out


def write_results(folder: str, answered: DataFrame, node_vectors: DataFrame, edge_vectors: DataFrame) -> None:
    """Answers as JSON lines, by all tasks; the statistics of the index, two rows, as one list."""
    tables.write_json(answered, f"{folder}/qa_results")
    tables.write_json_list(index_statistics(node_vectors, edge_vectors), f"{folder}/indexing_stats.json")


def index_statistics(node_vectors: DataFrame, edge_vectors: DataFrame) -> DataFrame:
    """store, total_vectors, dimension, index_type."""
    return vectors.statistics(node_vectors).withColumn("store", F.lit("nodes")).unionByName(vectors.statistics(edge_vectors).withColumn("store", F.lit("edges")))


def ask(asked: DataFrame, built: Built, node_vectors: DataFrame, edge_vectors: DataFrame, embedder: embedding.Embedder, strategy: str = "adaptive", client=None, citations: bool = False, config: EngineConfig = EngineConfig()) -> DataFrame:
    """query_id, answer, sources, confidence for questions (query_id, question): parse, retrieve, assemble, generate."""
    parsed = cut(questions.process(asked, embedder), "parsed")
    rows = cut(retrieval.retrieve(parsed, strategy, built.nodes, built.edges, node_vectors, edge_vectors, config.top_k, config.score_mode), "retrieved")
    around = None
    if strategy in ("hybrid", "adaptive"):
        hits = rows.where("kind = 'node'").select("query_id", "rank", F.col("name").alias("entity_name"))
        around = retrieval.expand(built.edges, hits, depth=config.max_depth, limit=config.path_limit)
    texts = context.truncate(context.assemble(asked, rows, strategy, around), config.max_tokens)
    return answers.generate(texts, client, citations)
