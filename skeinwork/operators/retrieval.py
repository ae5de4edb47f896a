"""Retrieval for tables of questions: by vectors, by the graph, by both, and by the strategy that the intent asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.config import STRATEGIES
from skeinwork.functions.storage import cut
from skeinwork.operators import graph, vectors

_OUT = ["query_id", "kind", "rank", "id", "name", "type", "source", "target", "score", "final_score", "boost", "section", "year", "value", "unit", "evidence", "method"]


def _shape(rows: DataFrame, kind: str, method: str) -> DataFrame:
    types = {"query_id": "string", "rank": "int", "score": "double", "final_score": "double", "boost": "double", "value": "double"}
    own = {"kind": F.lit(kind), "method": F.lit(method)}
    return rows.select(*[(own[c] if c in own else F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in _OUT])


def vector_nodes(parsed: DataFrame, node_vectors: DataFrame, k: int, filtered: bool = True) -> DataFrame:
    """query_id, rank, vec_id, distance and the vector's fields. With a node type asked for: 2k found, those of the type kept, cut to k."""
    if not filtered:
        return vectors.top_k(node_vectors, parsed, k)
    fits = F.col("node_type_filter").isNull() | (F.col("node_type") == F.col("node_type_filter"))
    return vectors.search(node_vectors, parsed, k, fits)


def edge_search(parsed: DataFrame, edge_vectors: DataFrame, k: int, relation: Column | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance and the edge's fields. relation: a column or value of the type asked for; 2k are found, those of the
    type kept, cut to k; where it is null nothing is kept out."""
    fits = None if relation is None else relation.isNull() | (F.col("relationship_type") == relation)
    return vectors.search(edge_vectors, parsed, k, fits)


def vector(parsed: DataFrame, node_vectors: DataFrame, edge_vectors: DataFrame, k: int = 10) -> DataFrame:
    nodes = vector_nodes(parsed, node_vectors, k).withColumns({"id": F.col("vec_id"), "name": F.col("entity_name"), "type": F.col("node_type"), "score": F.col("distance")})
    edges = edge_search(parsed, edge_vectors, k).withColumns({"id": F.col("vec_id"), "type": F.col("relationship_type"), "score": F.col("distance")})
    # properties of vector-found nodes are nested and stay out of sight
    return _shape(nodes.drop("section", "year", "value", "unit", "evidence"), "node", "vector_search").unionByName(_shape(edges, "edge", "vector_search"))


def seeds(parsed: DataFrame, nodes: DataFrame, n: int = 3) -> DataFrame:
    """query_id, at, seed: the first n named entities that are nodes."""
    named = parsed.select("query_id", F.posexplode(F.slice("entities", 1, n)).alias("at", "seed"))
    return named.join(nodes.select(F.col("name").alias("seed")).distinct(), "seed", "left_semi")


def by_graph(parsed: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10, depth: int = 2) -> DataFrame:
    """Seeds at 1.0, what is related to them at 0.8. Of a node found again the last finding counts, in the first one's place."""
    own = seeds(parsed, nodes)
    found = graph.related(edges, own.select("seed").distinct(), depth, k)
    each = cut(own.join(found, "seed"), "related")
    first = each.groupBy("query_id", "at", "node").agg(F.min("path_rank").alias("path_rank")).select("query_id", "at", "path_rank", F.col("node").alias("name"), F.lit(0.8).alias("score"))
    hits = own.select("query_id", "at", F.lit(0).alias("path_rank"), F.col("seed").alias("name"), F.lit(1.0).alias("score")).unionByName(first)
    place = F.struct("at", "path_rank")
    merged = hits.groupBy("query_id", "name").agg(F.min(place).alias("place"), F.max_by("score", place).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("place", "name"))
    ranked = merged.withColumn("rank", rank).where(F.col("rank") <= k)
    props = nodes.groupBy("name").agg(F.min_by(F.struct("node_type", "section", "year", "value", "unit"), "node_type").alias("p"))
    ranked = ranked.join(props, "name", "left").select("query_id", "rank", "name", "score", F.col("name").alias("id"), "p.section", "p.year", "p.value", "p.unit")
    lines = each.groupBy("query_id", "at", "first").agg(F.min("path_rank").alias("path_rank"))
    erank = F.row_number().over(W.partitionBy("query_id").orderBy("at", "path_rank", "first.edge_id"))
    lines = lines.withColumn("rank", erank).where(F.col("rank") <= k)
    lines = lines.select("query_id", "rank", F.concat_ws("_", "first.source", "first.type", "first.target").alias("id"), "first.type", "first.source", "first.target", F.lit(0.8).alias("score"))
    return _shape(ranked, "node", "graph_traversal").unionByName(_shape(lines, "edge", "graph_traversal"))


def boost(kind: str) -> Column:
    """Of a node: 1.5 for the type that is asked for, 2 for a name in the question. Of an edge: 1.3 for a year in the question."""
    if kind == "node":
        return F.when(F.col("node_type") == F.col("node_type_filter"), 1.5).otherwise(1.0) * F.when(F.array_contains("entities", F.col("entity_name")), 2.0).otherwise(1.0)
    return F.when(F.exists("temporal", lambda t: F.coalesce(F.col("year"), F.lit("")).contains(t)), 1.3).otherwise(1.0)


def rerank(hits: DataFrame, kind: str, score_mode: str = "distance") -> DataFrame:
    """final_score = min(base * boost, 1), largest first, ties as they came. The base is the distance, as specified, or 1 / (1 + distance)."""
    base = F.col("distance") if score_mode == "distance" else vectors.similarity(F.col("distance"))
    out = hits.withColumn("boost", boost(kind)).withColumn("final_score", F.least(base * F.col("boost"), F.lit(1.0)))
    order = W.partitionBy("query_id").orderBy(F.col("final_score").desc(), "rank")
    return out.withColumn("input_rank", F.col("rank")).withColumn("rank", F.row_number().over(order))


def expand(edges: DataFrame, hits: DataFrame, n: int = 5, depth: int = 2, limit: int = 50) -> DataFrame:
    """query_id, nodes, node_count, edge_count: what is around the first n named hits; nodes once, edges as often as found."""
    named = hits.where(F.col("entity_name").isNotNull() & (F.col("entity_name") != "")).withColumn("at", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("at") <= n)
    own = named.select("query_id", "at", F.col("entity_name").alias("seed"))
    found = own.join(graph.related(edges, own.select("seed").distinct(), depth, limit), "seed")
    nodes = found.groupBy("query_id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    lines = found.groupBy("query_id").agg(F.countDistinct("at", "first").alias("edge_count"))
    return nodes.join(lines, "query_id").select("query_id", "nodes", F.size("nodes").alias("node_count"), "edge_count")


def hybrid(parsed: DataFrame, node_vectors: DataFrame, edge_vectors: DataFrame, k: int = 10, score_mode: str = "distance") -> DataFrame:
    nodes = rerank(vector_nodes(parsed, node_vectors, k, filtered=False), "node", score_mode)
    edges = rerank(vectors.top_k(edge_vectors, parsed, k), "edge", score_mode)
    nodes = nodes.withColumns({"id": F.col("vec_id"), "name": F.col("entity_name"), "type": F.col("node_type"), "score": F.col("distance")}).drop("section", "year", "value", "unit", "evidence")
    edges = edges.withColumns({"id": F.col("vec_id"), "type": F.col("relationship_type"), "score": F.col("distance")})
    return _shape(nodes, "node", "hybrid").unionByName(_shape(edges, "edge", "hybrid"))


def retrieve(parsed: DataFrame, strategy: str, nodes: DataFrame, edges: DataFrame, node_vectors: DataFrame, edge_vectors: DataFrame, k: int = 10, score_mode: str = "distance", node_type: str | None = None) -> DataFrame:
    """The rows for each question. node_type overrides what the questions ask for; adaptive sends each question down its own route."""
    if node_type is not None:
        parsed = parsed.withColumn("node_type_filter", F.lit(node_type))
    if strategy == "vector":
        return vector(parsed, node_vectors, edge_vectors, k)
    if strategy == "graph":
        return by_graph(parsed, nodes, edges, k)
    if strategy == "hybrid":
        return hybrid(parsed, node_vectors, edge_vectors, k, score_mode)
    if strategy != "adaptive":
        raise ValueError(f"unknown strategy {strategy!r}")
    parts = [retrieve(parsed.where(F.col("route") == s), s, nodes, edges, node_vectors, edge_vectors, k, score_mode) for s in ("vector", "graph", "hybrid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def statistics(node_vectors: DataFrame | None, edge_vectors: DataFrame | None) -> dict:
    """Whether both vector stores are there, and the strategies."""
    return {"hybrid_store_indexed": node_vectors is not None and edge_vectors is not None, "available_strategies": list(STRATEGIES)}


def scores(rows: DataFrame) -> DataFrame:
    """query_id, avg_node_score: the mean of the nodes' final scores, else of their scores; 0 without nodes."""
    own = F.when(F.col("kind") == "node", F.coalesce("final_score", "score"))
    return rows.groupBy("query_id").agg(F.coalesce(F.avg(own), F.lit(0.0)).alias("avg_node_score"))


def similar_and_related(parsed: DataFrame, node_vectors: DataFrame, edges: DataFrame, k: int = 10, threshold: float = 0.7, depth: int = 2, expand_names: int = 5) -> DataFrame:
    """query_id, rank, name, similarity_score, origin: vector hits of similarity `threshold` or more, and what is around the first
    `expand_names` of them at 0.5 / (distance + 1); the k best of both."""
    hits = vectors.above_threshold(vectors.top_k(node_vectors, parsed, 4 * k), threshold).where(F.col("rank") <= 2 * k)
    near = hits.select("query_id", F.col("entity_name").alias("name"), F.col("similarity").alias("similarity_score"), F.lit("vector").alias("origin"))
    seeds = hits.where("entity_name is not null").select("query_id", F.col("entity_name").alias("seed")).distinct()
    seeds = seeds.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("seed"))).where(F.col("n") <= expand_names)
    around = graph.k_hop(edges, seeds.select("seed").distinct(), depth).where("distance > 0")
    found = seeds.join(around, "seed").select("query_id", F.col("node").alias("name"), (F.lit(0.5) / (F.col("distance") + 1)).alias("similarity_score"), F.lit("graph").alias("origin"))
    order = W.partitionBy("query_id").orderBy(F.col("similarity_score").desc(), F.col("origin").desc(), "name")
    return near.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
