"""The property graph as tables: nodes(node_id, node_type, name, ...), edges(source, target, type, ...), and what is asked of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut
from skeinwork.functions.text import left, path_name


def primary(entities: DataFrame) -> DataFrame:
    """Entities that become nodes: keys, and all that don't come from an evidence note."""
    return entities.where(F.col("is_key") | F.col("column").isNull() | (F.col("column") != "evidence_note"))


#: The properties that entities give their nodes.
FIELDS = ("confidence", "source", "chunk_id", "column", "is_key", "section", "year", "parent_section", "value", "unit")


def node_entities(entities: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The columns of entities that nodes of these fields are made of; dedup then carries no others."""
    return entities.select(*dict.fromkeys(["text", "type", "confidence", "column", "is_key", "ord", *fields]))


def entity_nodes(entities: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One node for each exact text; the last entity of a text gives its properties, those of `fields`."""
    last = F.max_by(F.struct("type", *fields), "ord")
    nodes = primary(entities).groupBy("text").agg(last.alias("e"))
    return nodes.select(F.col("text").alias("node_id"), F.col("e.type").alias("node_type"), F.col("text").alias("name"), *[F.col(f"e.{f}").alias(f) for f in fields])


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """A CHUNK node for each chunk; one without an id gets a hash of what it is."""
    known = F.coalesce("chunk_id", F.concat(F.lit("chunk_"), F.sha2(F.concat_ws("\x1f", "source_doc", "ord", "text"), 256)))
    return chunks.select(known.alias("node_id"), F.lit("CHUNK").alias("node_type"), left(F.col("text"), 500).alias("text"), F.col("text").alias("full_text"), F.col("source_doc").alias("source"))


def mentions(entities: DataFrame) -> DataFrame:
    """MENTIONS edges from chunks to their entities."""
    return primary(entities).where("chunk_id is not null").select(F.col("chunk_id").alias("source"), F.col("text").alias("target"), F.lit("MENTIONS").alias("type"), "confidence", F.col("type").alias("entity_type"), "ord")


def relation_edges(relations: DataFrame) -> DataFrame:
    """Edges from relationships that have both ends; ends may be in no node."""
    keep = [c for c in ("chunk_id", "source_doc", "context", "year", "section", "value", "unit", "evidence") if c in relations.columns]
    return relations.where("source is not null and target is not null").select("source", "target", F.coalesce("type", F.lit("RELATED_TO")).alias("type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *keep, "ord")


def build(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus."""
    nodes = entity_nodes(entities).unionByName(chunk_nodes(chunks).withColumn("name", F.lit(None).cast("string")), allowMissingColumns=True)
    return nodes, relation_edges(relations).unionByName(mentions(entities), allowMissingColumns=True)


def statistics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: total nodes (different texts), entities by type (as added, so one text may count twice), edges and edges by type."""
    own = primary(entities)
    # texts of a type are counted once for both: how often they are, and that they are
    pairs = own.groupBy("text", "type").agg(F.count("*").alias("n"))
    first = pairs.groupBy("text").agg(F.collect_list(F.struct("type", "n")).alias("types"))
    each = first.select(F.explode(F.concat(F.array(F.struct(F.lit("total_nodes").alias("kind"), F.lit("all").alias("name"), F.lit(1).cast("long").alias("n"))), F.transform("types", lambda t: F.struct(F.lit("node_type").alias("kind"), t["type"].alias("name"), t["n"].alias("n"))))).alias("x"))
    nodes = each.groupBy("x.kind", "x.name").agg(F.sum("x.n").alias("n"))
    lines = edges.rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("g"))
    lines = lines.select(F.when(F.col("g") == 1, "total_edges").otherwise("edge_type").alias("kind"), F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("name"), "n")
    return nodes.unionByName(lines)


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each end; a loop counts twice, nodes without edges aren't there. Ends are counted before they are shuffled."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, edge: each edge from either end, with its type and id if they are there."""
    names = ["source", "target", *[c for c in ("type", "edge_id") if c in edges.columns]]
    e = edges.select(*names)
    keep = F.struct(*names).alias("edge")
    return e.select(F.col("source").alias("a"), F.col("target").alias("b"), keep).union(e.where("source <> target").select(F.col("target").alias("a"), F.col("source").alias("b"), keep))


#: What joins reached rows (node and more) with the edges at their nodes, as b and edge.
Meet = Callable[[DataFrame], DataFrame]


def meeting(edges: DataFrame) -> Meet:
    """Over a table of edges: both sides are shuffled by the node. A stored index (graph_index.Index.meet) leaves its edges where they are."""
    step = both_ways(edges)
    return lambda reached: reached.join(step, reached["node"] == step["a"]).select(*[reached[c] for c in reached.columns], "b", "edge")


def k_hop(edges: DataFrame | None, seeds: DataFrame, depth: int = 2, meet: Meet | None = None) -> DataFrame:
    """seed, node, distance: breadth-first reach over undirected edges. seeds: seed. Each hop's frontier holds new nodes alone, once each.
    meet: how edges are found, by default in `edges`."""
    meet = meet or meeting(edges)
    # stored, so that Spark knows their size: a few seeds are broadcast, and the first hop shuffles no edges either
    reached = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), "hop-0")
    frontier = reached
    for hop in range(1, depth + 1):
        nxt = meet(frontier).select("seed", F.col("b").alias("node")).distinct()
        frontier = cut(nxt.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(hop)), f"hop-{hop}")
        reached = reached.unionByName(frontier)
    return reached


def ego(nodes: DataFrame, edges: DataFrame | None, center: str, depth: int = 2, mode: str = "bfs", meet: Meet | None = None) -> DataFrame:
    """node, distance around a known node. compat: only one hop is taken, whatever the depth. An unknown center gives nothing."""
    known = nodes.select(F.col("node_id").alias("seed")).where(F.col("seed") == center)
    return k_hop(edges, known, 1 if mode == "compat" else depth, meet).join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi").select("node", "distance")


def ego_edges(edges: DataFrame, reached: DataFrame, depth: int = 2) -> DataFrame:
    """The edges of an ego graph, those with an end at a distance below `depth`, once each. reached: node, distance (ego() or k_hop())."""
    inner = reached.where(F.col("distance") < depth).select(F.col("node").alias("__end")).distinct()
    both = edges.join(inner, edges["source"] == inner["__end"], "left_semi").union(edges.join(inner, edges["target"] == inner["__end"], "left_semi"))
    return both.dropDuplicates(["edge_id"])


def neighbours(edges: DataFrame | None, seeds: DataFrame, depth: int = 1, limit: int = 100, meet: Meet | None = None) -> DataFrame:
    """Other nodes within `depth`, the first `limit` of each seed in order of distance and name."""
    near = k_hop(edges, seeds, depth, meet).where("distance > 0")
    rank = F.row_number().over(W.partitionBy("seed").orderBy("distance", "node"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit)


def related(edges: DataFrame | None, seeds: DataFrame, depth: int = 2, limit: int = 50, meet: Meet | None = None) -> DataFrame:
    """seed, path_rank, node, first (edge), length: undirected paths of up to `depth` different edges from each seed, the first `limit` in
    order of length and edge ids. Shorter paths come first, so a seed that has `limit` of them goes no further, and no seed carries
    more than `limit` paths into a hop."""
    meet = meet or meeting(edges)
    edge = "struct<source:string,target:string,type:string,edge_id:string>"
    # stored as in k_hop
    paths = cut(seeds.select("seed", F.col("seed").alias("node"), F.array().cast("array<string>").alias("trail"), F.lit(None).cast(edge).alias("first")).distinct(), "trail-0")
    order = [F.array_join("trail", "\x1f"), F.col("node")]
    found = None
    for hop in range(1, depth + 1):
        nxt = meet(paths).where(~F.array_contains("trail", F.col("edge.edge_id")))
        nxt = nxt.select("seed", F.col("b").alias("node"), F.array_append("trail", F.col("edge.edge_id")).alias("trail"), F.coalesce("first", "edge").alias("first"))
        done = nxt.withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy(*order))).where(F.col("n") <= limit).drop("n").withColumn("length", F.lit(hop))
        if hop < depth:
            done = cut(done, f"trail-{hop}")
        found = done if found is None else found.unionByName(done)
        if hop < depth:
            enough = found.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
            paths = done.join(enough, "seed", "left_anti").drop("length")
    rank = F.row_number().over(W.partitionBy("seed").orderBy("length", *order))
    return found.withColumn("path_rank", rank).where(F.col("path_rank") <= limit).select("seed", "path_rank", "node", "first", "length")


def upsert_nodes(entities: DataFrame) -> DataFrame:
    """One row for each type and name; of each property the last value that isn't null stays."""
    fields = ["confidence", "source", "chunk_id", "column", "is_key", "section", "year", "parent_section", "value", "unit"]
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields]
    return primary(entities).groupBy(F.col("type").alias("node_type"), F.col("text").alias("name")).agg(*last)


def upsert_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk rows by chunk_id: what new says of a known chunk replaces what was stored, column by column, where it isn't null. new may have
    columns that the store lacks; of several new rows of a chunk the last by `ord` counts."""
    names = list(dict.fromkeys([*stored.columns, *new.columns]))
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    order = F.struct("__new", "ord") if "ord" in names else F.struct("__new")
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in names if c != "chunk_id"]
    return both.where("chunk_id is not null").groupBy("chunk_id").agg(*last).select(*names)


def add_chunks(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with new chunks, their entities and the MENTIONS edges between them. What is there already stays once: a node by its
    id and type, an edge by its ends and type. chunks: chunk_id, source_doc, ord, text; entities as extracted from them."""
    kept = chunks.where("chunk_id is not null")
    fresh = entity_nodes(entities).unionByName(chunk_nodes(kept).withColumn("name", F.lit(None).cast("string")), allowMissingColumns=True)
    fresh = fresh.join(nodes.select("node_id", "node_type"), ["node_id", "node_type"], "left_anti")
    links = mentions(entities).groupBy("source", "target", "type").agg(F.min_by(F.struct("confidence", "entity_type", "ord"), "ord").alias("m")).select("source", "target", "type", "m.*")
    links = links.join(edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
    return nodes.unionByName(fresh, allowMissingColumns=True), edges.unionByName(links, allowMissingColumns=True)


def upsert_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each (source, type, target) whose ends are both names; of each property the last value stays. names: name."""
    names = names.select("name").distinct()
    linked = edges.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    kind = F.upper(F.translate("type", " -", "__"))
    fields = [c for c in ("confidence", "chunk_id", "source_doc", "context", "year", "section", "value", "unit", "evidence") if c in edges.columns]
    last = [F.max_by(F.left(F.col(f), F.lit(500)) if f == "context" else F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in fields]
    return linked.groupBy("source", kind.alias("type"), "target").agg(F.count("*").alias("__n"), *last).drop("__n")


def persist(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as Parquet, by node and edge type. Documents go by their file's name without .csv, chunk texts up to 1000 characters."""
    doc = F.regexp_replace(path_name(F.col("source")), r"\.csv$", "")
    nodes = nodes.withColumn("doc_id", doc)
    if "text" in nodes.columns:
        nodes = nodes.withColumn("text", left(F.col("text"), 1000))
    if "context" in edges.columns:
        edges = edges.withColumn("context", left(F.col("context"), 500))
    nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def clear(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """An empty graph of the same columns in the folder."""
    nodes.limit(0).write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.limit(0).write.mode("overwrite").parquet(f"{folder}/edges")


def sql(spark, text: str, nodes: DataFrame, edges: DataFrame, **args) -> DataFrame:
    """A query over {nodes} and {edges}; args are bound, not pasted."""
    return spark.sql(text, args=args or None, nodes=nodes, edges=edges)


def get_entity(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a name; of several the first by type."""
    return nodes.where(F.col("name") == name).orderBy("node_type", "node_id").limit(1)


def query_edges(edges: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None, limit: int = 100) -> DataFrame:
    """Edges by any of their ends and type, the first `limit` in a fixed order."""
    for column, value in (("source", source), ("target", target), ("type", kind)):
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges.orderBy("source", "type", "target", "ord").limit(limit)


def for_indexing(nodes: DataFrame, edges: DataFrame, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What is to be embedded: all, or the given types. The filters reach the partitions of a stored graph."""
    return nodes.where(F.col("node_type").isin(node_types)) if node_types else nodes, edges.where(F.col("type").isin(edge_types)) if edge_types else edges
