"""Context texts for a model, from retrieval rows: one text for each question, with its sources and a token estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.text import left
from skeinwork.operators.chunking import token_estimate

#: Headings and marks of the layouts.
HEAD = {"vector": "\n=== RELEVANT ENTITIES ===\n", "graph": "\n=== KNOWLEDGE GRAPH CONTEXT ===\n", "hybrid": "\n=== HYBRID CONTEXT (Vector + Graph) ===\n\n--- Most Relevant Entities ---\n"}
EDGE_HEAD = {"vector": "\n\n=== RELEVANT RELATIONSHIPS ===\n", "hybrid": "\n\n--- Key Relationships ---\n"}
LIMITS = {"vector": (15, 10, 150, 100), "graph": (10, 5, 0, 80), "hybrid": (8, 8, 120, 100)}
CUT_MARK = "\n\n[... context truncated ...]"


def entities(rows: DataFrame) -> DataFrame:
    """Node rows as entities: missing names and types named, the final score where there is one."""
    own = rows.where("kind = 'node'")
    return own.select("query_id", "rank", F.coalesce("name", F.lit("Unknown")).alias("name"), F.coalesce("type", F.lit("ENTITY")).alias("type"), F.coalesce("final_score", "score", F.lit(0.0)).alias("score"), F.coalesce("boost", F.lit(1.0)).alias("boost"), "section", "year", "value", "unit", "evidence", "source")


def relationships(rows: DataFrame, labels: bool = False) -> DataFrame:
    """Edge rows as relationships. Graph-found edges carry their type under another name and so print RELATED_TO, unless labels."""
    kind = F.col("type") if labels else F.when(F.col("method") != "graph_traversal", F.col("type"))
    own = rows.where("kind = 'edge'")
    return own.select("query_id", "rank", F.coalesce("source", F.lit("Unknown")).alias("source"), F.coalesce("target", F.lit("Unknown")).alias("target"), F.coalesce(kind, F.lit("RELATED_TO")).alias("type"), F.coalesce("final_score", "score", F.lit(0.0)).alias("score"), "section", "year", "evidence")


def _some(prefix: str, c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(prefix), c), F.lit(""))


def _once(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n by rank, and of those with equal keys the first; numbers keep their gaps."""
    return rows.where(F.col("rank") <= n).withColumn("__n", F.row_number().over(W.partitionBy("query_id", *keys).orderBy("rank"))).where("__n = 1").drop("__n")


def _joined(rows: DataFrame, line: Column, name: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias(name))


def _fixed3(c: Column) -> Column:
    return F.format_string("%.3f", c.cast("double"))


def connections(ents: DataFrame, rels: DataFrame, n: int = 10, each: int = 5) -> DataFrame:
    """query_id, rank (entity), at, and the relationship: the first `each` of each entity, found by two equi-joins, by source and by target."""
    e = ents.where(F.col("rank") <= n).select("query_id", F.col("rank").alias("e_rank"), "name")
    r = rels.withColumnRenamed("rank", "r_rank")
    out = e.join(r, (e["query_id"] == r["query_id"]) & (e["name"] == r["source"])).drop(r["query_id"]).withColumn("outward", F.lit(True))
    into = e.join(r, (e["query_id"] == r["query_id"]) & (e["name"] == r["target"]) & (r["source"] != r["target"])).drop(r["query_id"]).withColumn("outward", F.lit(False))
    at = F.row_number().over(W.partitionBy("query_id", "e_rank").orderBy("r_rank"))
    return out.unionByName(into).withColumn("at", at).where(F.col("at") <= each)


def assemble(questions: DataFrame, rows: DataFrame, layout: str = "hybrid", subgraphs: DataFrame | None = None, labels: bool = False) -> DataFrame:
    """query_id, context_text, entity_count, relationship_count, sources, token_count. The adaptive strategy has the hybrid layout."""
    layout = layout if layout in HEAD else "hybrid"
    rows = rows.withColumn("query_id", F.col("query_id").cast("string"))
    questions = questions.withColumn("query_id", F.col("query_id").cast("string"))
    ents, rels = entities(rows), relationships(rows, labels)
    most, most_rels, cut_e, cut_r = LIMITS[layout]
    number = F.concat(F.lit("\n"), F.col("rank").cast("string"), F.lit(". "))
    base = questions.select("query_id", "question")
    if layout == "graph":
        arrow = F.when(F.col("outward"), F.concat(F.lit("   - "), "type", F.lit(" → "), "target")).otherwise(F.concat(F.lit("   - "), "source", F.lit(" → "), "type"))
        line = F.concat(arrow, F.coalesce(F.concat(F.lit("     ("), left(F.col("evidence"), cut_r), F.lit(")")), F.lit("")))
        links = connections(ents, rels, most, most_rels)
        links = links.groupBy("query_id", F.col("e_rank").alias("rank")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "").alias("links"))
        shown = ents.where(F.col("rank") <= most).join(links, ["query_id", "rank"], "left")
        text = F.concat(number, "name", F.lit(" ("), "type", F.lit(")"), _some("   Connections:", F.col("links")), _some("   From: ", F.col("section")), _some("   Year: ", F.col("year")))
        base = base.join(_joined(shown, text, "e_text"), "query_id", "left").withColumn("r_text", F.lit(None).cast("string"))
    else:
        relevance = F.concat(F.lit(" [Relevance: "), _fixed3(F.col("score")), F.lit("]") if layout == "vector" else F.concat(F.lit(", Boost: "), F.format_string("%.2f", F.col("boost")), F.lit("]")))
        props = [_some("   Section: ", F.col("section")), _some("   Year: ", F.col("year"))]
        if layout == "vector":
            props.append(_some("   Value: ", F.concat(F.col("value").cast("string"), F.lit(" "), "unit")))
        text = F.concat(number, "name", F.lit(" ("), "type", F.lit(")"), relevance, *props, _some("   Evidence: ", left(F.col("evidence"), cut_e)))
        rel = F.concat(number, "source", F.lit(" --["), "type", F.lit("]--> "), "target", F.lit(" [Relevance: "), _fixed3(F.col("score")), F.lit("]"), _some("   Context: ", left(F.col("evidence"), cut_r)), _some("   From: ", F.col("section")) if layout == "hybrid" else F.lit(""))
        base = base.join(_joined(_once(ents, most, "name"), text, "e_text"), "query_id", "left")
        base = base.join(_joined(_once(rels, most_rels, "source", "type", "target"), rel, "r_text"), "query_id", "left")
    around = F.lit("")
    if layout == "hybrid" and subgraphs is not None:
        base = base.join(subgraphs.withColumn("query_id", F.col("query_id").cast("string")), "query_id", "left")
        around = F.when(
            F.coalesce("node_count", F.lit(0)) > 0,
            F.concat(F.lit("\n\n--- Connected Graph Neighborhood ---\n  Total connected entities: "), F.col("node_count").cast("string"), F.lit("  Total relationships: "), F.col("edge_count").cast("string"), F.lit("\n  Connected entities: "), F.array_join(F.slice("nodes", 1, 10), ", ")),
        ).otherwise("")
    text = F.concat(F.lit("Query: "), "question", F.lit("\n" + HEAD[layout]), F.coalesce("e_text", F.lit("")), _some(EDGE_HEAD.get(layout, ""), F.col("r_text")), around)
    counts = rows.groupBy("query_id").agg(F.count_if(F.col("kind") == "node").alias("entity_count"), F.count_if(F.col("kind") == "edge").alias("relationship_count"))
    base = base.select("query_id", "question", text.alias("context_text")).join(counts, "query_id", "left").join(sources(rows), "query_id", "left")
    return base.select("query_id", "question", "context_text", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("relationship_count", F.lit(0)).alias("relationship_count"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), token_estimate(F.col("context_text")).alias("token_count"))


def sources(rows: DataFrame) -> DataFrame:
    """query_id, sources: what entities come from, and sections of entities and relationships, each once, in order."""
    own = rows.select("query_id", F.explode(F.array(F.when(F.col("kind") == "node", F.col("source")), F.concat(F.lit("Section: "), "section"))).alias("s")).where("s is not null")
    return own.groupBy("query_id").agg(F.array_sort(F.collect_set("s")).alias("sources"))


def truncate(contexts: DataFrame, max_tokens: int) -> DataFrame:
    """Texts over the limit cut to four characters a token, with a mark."""
    over = F.col("token_count") > max_tokens
    text = F.when(over, F.concat(left(F.col("context_text"), 4 * max_tokens), F.lit(CUT_MARK))).otherwise(F.col("context_text"))
    return contexts.withColumn("truncated", over).withColumn("context_text", text).withColumn("token_count", token_estimate(F.col("context_text")))
