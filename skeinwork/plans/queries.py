"""The query catalogue: each operator of the engine over the test tables. A query takes (spark, sf_dir) and gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut, shared_dir
from skeinwork.operators import answers, chunking, context, embedding, graph, graph_index, ivf_pq, questions, retrieval, vectors
from skeinwork.operators import entities as E
from skeinwork.operators import patterns as P
from skeinwork.operators import relations as R
from skeinwork.sources import files, tables
from skeinwork.sources import fixtures as fx
from skeinwork.streaming import graph_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ENTITY_OUT = ["chunk_id", "text", "type", "column", "is_key", "confidence", "section", "year", "relation", "entity_category", "value", "unit", "derived_from"]
RELATION_OUT = ["chunk_id", "source", "target", "type", "confidence", "year", "section", "value", "unit", "source_type", "target_type"]


def query(f: Query) -> Query:
    """Registers a query; whole numbers come out as long, doubles rounded to six places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        kinds = dict(df.dtypes)
        return df.select(*[F.col(c).cast("long").alias(c) if k in ("int", "smallint", "tinyint") else F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()])

    run.__name__ = f.__name__
    QUERIES[f.__name__] = run
    return f


# chunking


def _docs(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", "text")


@query
def chunk_csv_row_kv(spark, d):
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return chunking.csv_rows(fx.table(spark, d, "customer"), names, "c_custkey").select("chunk_id", "row_index", "text", "chunk_type")


@query
def chunk_csv_row_sentence(spark, d):
    return chunking.csv_rows(fx.table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"], "c_custkey", "sentence").select("chunk_id", "text")


@query
def chunk_csv_row_json(spark, d):
    return chunking.csv_rows(fx.table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"], "c_custkey", "json").select("chunk_id", "text")


@query
def chunk_sentence(spark, d):
    return chunking.sentences(_docs(spark, d))


@query
def chunk_fixed(spark, d):
    return chunking.fixed_size(_docs(spark, d))


@query
def chunk_semantic(spark, d):
    return chunking.semantic(_docs(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n")))


@query
def chunk_token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", chunking.token_estimate(F.col("text")).alias("tokens"))


# entities


@query
def entities_keyword(spark, d):
    return E.keyword_entities(fx.text_chunks(spark, d)).select("chunk_id", "source", "text", "type", "confidence", "start", "end")


def _kind(kind: str) -> Query:
    return lambda spark, d: E.keyword_entities(fx.text_chunks(spark, d), kind == "EMAIL", kind == "URL", kind == "NUMBER").where(F.col("type") == kind).groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_chunks"))


for _name, _type in (("entities_capitalized", "NAMED_ENTITY"), ("entities_email", "EMAIL"), ("entities_number", "NUMBER")):
    _f = _kind(_type)
    _f.__name__ = _name
    query(_f)


@query
def entities_url(spark, d):
    chunks = fx.table(spark, d, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("chunk_id"), F.lit("pages").alias("source_doc"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("ord"), F.concat("url", F.lit(" "), F.coalesce("html", F.lit(""))).alias("text"))
    return E.keyword_entities(chunks, False, True, False).where("type = 'URL'").select("chunk_id", "text")


@query
def entities_csv_relations(spark, d):
    return E.row_entities(fx.er_rows(spark, d)).select(*ENTITY_OUT)


@query
def entities_csv_sections(spark, d):
    return E.row_entities(fx.ss_rows(spark, d)).select("chunk_id", "text", "type", "column", "is_key", "confidence", "section", "year", "parent_section")


@query
def entities_csv_generic(spark, d):
    rows = fx.table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("ord"), F.lit("customer.csv").alias("source_doc"), F.col("c_custkey").cast("string").alias("chunk_id"), F.col("c_custkey"), "c_name", "c_nationkey", "c_mktsegment")
    return E.row_entities(rows).select("chunk_id", "text", "type", "column", "is_key", "confidence")


@query
def entities_evidence(spark, d):
    return E.row_entities(fx.er_rows(spark, d)).where("column = 'evidence_note'").groupBy("text", "type").agg(F.count("*").alias("n"))


@query
def entity_classify(spark, d):
    names = fx.er_rows(spark, d).select(F.explode(F.array("source", "target")).alias("text")).distinct()
    return names.select("text", E.classify(F.col("text"), True).alias("as_source"), E.classify(F.col("text"), False).alias("as_target"))


@query
def entity_target_type(spark, d):
    rows = fx.er_rows(spark, d).select("target_type", "target").distinct()
    return rows.groupBy("target_type", E.target_type(F.col("target_type"), F.col("target")).alias("mapped")).agg(F.count("*").alias("n"))


@query
def entities_dedup(spark, d):
    return E.dedup(E.row_entities(fx.er_rows(spark, d))).select("ord", *ENTITY_OUT)


@query
def entity_summary(spark, d):
    return E.summary(E.dedup(E.row_entities(fx.er_rows(spark, d))))


@query
def entity_samples(spark, d):
    return E.samples(E.dedup(E.row_entities(fx.er_rows(spark, d))))


@query
def llm_response_parse(spark, d):
    return E.parse_responses(fx.responses(spark, d)).select("chunk_id", "text", "type", "confidence", "extraction_method")


# relationships


@query
def rel_cooccurrence(spark, d):
    chunks = fx.text_chunks(spark, d)
    return R.cooccurrence(chunks, E.keyword_entities(chunks)).select("chunk_id", "source", "target", "type", "confidence", "context", "source_type", "target_type")


@query
def rel_pattern(spark, d):
    return R.pattern_relations(fx.text_chunks(spark, d)).select("chunk_id", "source", "target", "type", "confidence", "context")


def _stored_rows(spark, d):
    """The entity-relation rows, stored; what says the same of every row, or what `ord` says, is not written but added again."""
    rows = fx.er_rows(spark, d)
    stored = cut(rows.drop("chunk_id", "source_doc"), "er-rows")
    return stored.select(F.concat(F.lit("er_"), "ord").alias("chunk_id"), F.lit("er.csv").alias("source_doc"), "*").select(*rows.columns)


def _er(spark, d):
    rows = _stored_rows(spark, d)
    found = E.row_entities(rows)
    return rows, found, R.row_relations(rows, E.dedup(found.select(*R.TYPED)))


@query
def rel_csv_relations(spark, d):
    return _er(spark, d)[2].select(*RELATION_OUT)


@query
def rel_csv_sections(spark, d):
    return R.section_relations(fx.ss_rows(spark, d)).select("chunk_id", "source", "target", "type", "confidence", "year", "section")


@query
def rel_csv_generic(spark, d):
    key = F.col("c_custkey").cast("string")
    rows = fx.table(spark, d, "customer").select(F.lpad(key, 12, "0").alias("ord"), F.lit("customer.csv").alias("source_doc"), key.alias("chunk_id"), "c_custkey", "c_name", "c_nationkey")
    return R.table_relations(rows, None).select("chunk_id", "source", "target", "type", "column", "confidence")


@query
def rel_content_mentions(spark, d):
    rows = fx.ss_rows(spark, d)
    return R.content_mentions(rows, E.row_entities(rows)).groupBy("source", "target", "type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


@query
def rel_dedup(spark, d):
    return R.dedup(_er(spark, d)[2]).select("ord", "source", "target", "type", "confidence")


# graph


#: What walks and patterns ask of an edge.
WALK = ("source", "target", "type", "edge_id")


def _own(rows, fields=()):
    """Unique entities of the rows, with what nodes of these fields are made of. Evidence gives no nodes and has types of its own, so no note is searched."""
    return E.dedup(graph.node_entities(E.row_entities(rows.drop("evidence_note")), fields))


def _nodes(spark, d, fields=graph.FIELDS):
    return graph.entity_nodes(_own(fx.er_rows(spark, d), fields), fields)


def _edges(rows, kind=None):
    """Edges say nothing of the types of their ends, so no entities are looked up for them. kind: those of one type; few, they are made unique
    by themselves, and no row is shuffled for them."""
    unique = R.unique_row_relations(rows) if kind is None else R.dedup(R.row_relations(rows, kind=kind))
    return graph.relation_edges(unique).withColumn("edge_id", F.col("ord"))


def _walks(spark, d, columns=WALK):
    """The edges of the entity-relation rows as walks need them, stored."""
    return cut(_edges(fx.er_rows(spark, d)).select(*columns), "edges")


def _graph(spark, d, fields=graph.FIELDS, columns=None):
    """(nodes, edges) of the entity-relation rows, stored. fields: the properties of nodes that are asked for, columns: those of edges (None: all)."""
    rows = _stored_rows(spark, d)
    nodes = cut(graph.entity_nodes(_own(rows, fields), fields), "nodes")
    edges = _edges(rows)
    return nodes, cut(edges.select(*columns) if columns else edges, "edges")


def _counted(spark, d):
    """(unique entities, edges) of the entity-relation rows with what statistics count."""
    rows = _stored_rows(spark, d)
    return _own(rows), _edges(rows)


@query
def graph_nodes(spark, d):
    return _nodes(spark, d).select("node_id", "node_type", "name", "confidence", "chunk_id", "column", "is_key", "section", "year", "value", "unit")


@query
def graph_chunk_nodes(spark, d):
    return graph.chunk_nodes(fx.text_chunks(spark, d)).select("node_id", "node_type", "text", "source")


@query
def graph_edges(spark, d):
    return _edges(fx.er_rows(spark, d)).select("edge_id", "source", "target", "type", "confidence", "year", "section", "value", "unit", "evidence")


@query
def graph_mentions(spark, d):
    return graph.mentions(E.row_entities(fx.er_rows(spark, d))).select("source", "target", "type", "confidence", "entity_type")


@query
def graph_stats(spark, d):
    return graph.statistics(*_counted(spark, d))


@query
def graph_node_types(spark, d):
    return _nodes(spark, d, ()).groupBy("node_type").agg(F.count("*").alias("n"))


@query
def graph_edge_types(spark, d):
    return _edges(fx.er_rows(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@query
def graph_degree(spark, d):
    return graph.degrees(_edges(fx.er_rows(spark, d)))


@query
def graph_ego_compat(spark, d):
    nodes, edges = _graph(spark, d, (), WALK)
    return graph.ego(nodes, edges, "AFRICA", 2, "compat")


@query
def graph_ego_khop(spark, d):
    nodes, edges = _graph(spark, d, (), WALK)
    return graph.ego(nodes, edges, "AFRICA", 2)


@query
def graph_ego_edges(spark, d):
    nodes, edges = _graph(spark, d, (), WALK)
    return graph.ego_edges(edges, graph.ego(nodes, edges, "AFRICA", 2), 2).select("edge_id", "source", "target", "type")


@query
def graph_upsert_chunks(spark, d):
    """Stored chunks of documents, and new ones: those of labelled documents again, and conversations."""
    docs = fx.table(spark, d, "documents")
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id")
    stored = docs.select(key, F.col("source").alias("doc_id"), "text", F.lit("stored").alias("state"))
    again = fx.table(spark, d, "labels").select(key, F.lit("labelled").alias("state"))
    talk = fx.table(spark, d, "conversations").select(F.concat_ws("_", F.lit("conv"), "conv_id", "turn").alias("chunk_id"), F.col("role").alias("doc_id"), "text")
    return graph.upsert_chunks(stored, again.unionByName(talk, allowMissingColumns=True))


@query
def graph_add_chunks(spark, d):
    """Chunks of documents are there; all chunks come with their entities."""
    chunks = fx.text_chunks(spark, d)
    own = cut(E.keyword_entities(chunks).withColumn("column", F.lit(None).cast("string")), "entities")
    none = spark.createDataFrame([], "source string, target string, type string, confidence double, ord string")
    docs = chunks.where("chunk_id LIKE 'doc%'")
    nodes, edges = graph.build(docs, own.where("chunk_id LIKE 'doc%'"), none)
    nodes, edges = graph.add_chunks(nodes, edges.dropDuplicates(["source", "target", "type"]), chunks, own)
    parts = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("target"))
    return parts.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "target"))


@query
def graph_neighbors(spark, d):
    edges = _walks(spark, d, ("source", "target"))
    seeds = spark.createDataFrame([("AFRICA",), ("Brand#2",), ("Customer#000000001",)], "seed string")
    return graph.neighbours(edges, seeds, 2).select("seed", "rank", "node", "distance")


def _related(spark, d, names: list[str], depth: int):
    edges = _walks(spark, d)
    found = graph.related(edges, spark.createDataFrame([(n,) for n in names], "seed string"), depth, 12)
    return found.select("seed", "path_rank", "node", "length", F.col("first.edge_id").alias("first_edge"))


@query
def graph_related(spark, d):
    return _related(spark, d, ["EUROPE", "Supplier#000000001", "nobody"], 2)


@query
def graph_related_rows(spark, d):
    return _related(spark, d, ["AFRICA", "Brand#2", "Customer#000000001", "nobody"], 3)


def _indexed(spark, d):
    """The graph of the entity-relation rows as a stored index; hubs are those of more than 500 edges here, so that there are some."""
    nodes, edges = _graph(spark, d, ("confidence",), WALK)
    folder = _folder(spark, "graph-index")
    graph_index.build(nodes, edges, folder, buckets=16, part=500)
    return graph_index.load(spark, folder)


@query
def graph_index_related(spark, d):
    index = _indexed(spark, d)
    seeds = spark.createDataFrame([("AFRICA",), ("Brand#2",), ("Customer#000000001",), ("nobody",)], "seed string")
    return graph.related(None, seeds, 3, 12, index.meet).select("seed", "path_rank", "node", "length", F.col("first.edge_id").alias("first_edge"))


@query
def graph_index_ego(spark, d):
    index = _indexed(spark, d)
    return graph.ego(index.nodes, None, "AFRICA", 2, meet=index.meet)


@query
def graph_index_lookup(spark, d):
    return _indexed(spark, d).by_name("NATION_3").select("node_id", "node_type", "confidence")


@query
def graph_pattern_chain(spark, d):
    """Who placed an order, is based in a nation that is part of a region: customers of each region and what they placed."""
    nodes, edges = _graph(spark, d, (), WALK)
    of = [P.Node("who"), P.Node("order", "METRIC"), P.Node("nation"), P.Node("region", having={"name": "EUROPE"})]
    by = [P.Edge("who", "order", "PLACED", "placed"), P.Edge("who", "nation", "BASED_IN"), P.Edge("nation", "region", "PART_OF")]
    found = P.match(nodes, edges, of, by)
    return found.select(F.col("who.name").alias("who"), F.col("order.name").alias("order"), F.col("nation.name").alias("nation"), F.col("placed")[0].alias("edge_id"))


@query
def graph_pattern_run(spark, d):
    """One or two edges in a row, in either direction, from one supplier."""
    nodes, edges = _graph(spark, d, (), WALK)
    found = P.match(nodes, edges, [P.Node("a", having={"name": "Supplier#000000001"}), P.Node("b")], [P.Edge("a", "b", ["SUPPLIES", "IN_SECTION"], "run", either=True, least=1, most=2)])
    return found.groupBy(F.col("b.name").alias("name"), F.size("run").alias("length")).agg(F.count("*").alias("n"))


@query
def graph_pattern_loop(spark, d):
    """Two customers of one nation in one section of the market: a pattern that comes back to a node it has."""
    nodes, edges = _graph(spark, d, (), WALK)
    of = [P.Node("a", having={"name": "Customer#000000001"}), P.Node("nation"), P.Node("b"), P.Node("section", "SECTION")]
    by = [P.Edge("a", "nation", "BASED_IN"), P.Edge("b", "nation", "BASED_IN"), P.Edge("a", "section", "IN_SECTION"), P.Edge("b", "section", "IN_SECTION")]
    return P.match(nodes, edges, of, by).select(F.col("b.name").alias("name"), F.col("section.name").alias("section"))


@query
def graph_entity_lookup(spark, d):
    return graph.get_entity(_nodes(spark, d, ("confidence",)), "NATION_3").select("node_id", "node_type", "confidence")


@query
def graph_upsert_nodes(spark, d):
    return graph.upsert_nodes(E.row_entities(fx.er_rows(spark, d))).select("node_type", "name", "confidence", "chunk_id", "column", "is_key", "section", "year", "value", "unit")


def _streamed(spark, rows: DataFrame, start, *key: str) -> DataFrame:
    """rows as files that a stream takes two fifths of at a time; what its store says at the end. start(files, store, checkpoint, at once) begins
    the stream. Every task deals its rows to five files, so files grow in number, not in size, with the rows."""
    folder = _folder(spark, "stream")
    rows.withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(5))).write.partitionBy("part").parquet(f"{folder}/in")
    n = len(spark.read.parquet(f"{folder}/in").inputFiles())
    start(f"{folder}/in/*", f"{folder}/store", f"{folder}/checkpoint", -(-2 * n // 5)).awaitTermination()
    return graph_state.current(spark, f"{folder}/store", *key)


@query
def stream_degree(spark, d):
    edges = _edges(fx.er_rows(spark, d)).select("source", "target", "ord")
    return _streamed(spark, edges, lambda *paths: graph_state.degrees(spark, *paths), "node")


@query
def stream_nodes(spark, d):
    found = E.row_entities(fx.er_rows(spark, d))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    out = _streamed(spark, found, lambda files, store, checkpoint, n: graph_state.nodes(spark, files, schema, store, checkpoint, n), "node_type", "name")
    return out.select("node_type", "name", "confidence", "chunk_id", "column", "is_key", "section", "year", "value", "unit")


@query
def graph_upsert_edges(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.upsert_edges(edges, nodes).select("source", "type", "target", "confidence", "year", "section", "value", "unit", "evidence")


@query
def graph_rel_query(spark, d):
    return graph.query_edges(_edges(fx.er_rows(spark, d), "PART_OF"), kind="PART_OF").select("source", "target", "type", "confidence")


@query
def graph_db_stats(spark, d):
    nodes, edges = _graph(spark, d)
    a = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("nodes"))
    return a.unionByName(graph.upsert_edges(edges, nodes).groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relationships")))


@query
def graph_sql(spark, d):
    nodes, edges = _graph(spark, d, (), ("source", "type", "confidence"))
    return graph.sql(spark, "SELECT n.node_type, e.type, count(*) AS n FROM {nodes} n JOIN {edges} e ON n.name = e.source WHERE e.confidence >= :least GROUP BY ALL", nodes, edges, least=0.9)


@query
def graph_for_indexing(spark, d):
    nodes, edges = _graph(spark, d, (), ("type", "edge_id"))
    n, e = graph.for_indexing(nodes, edges, ["ORGANIZATION", "CONCEPT", "ENTITY"], ["SUPPLIES", "BASED_IN"])
    return n.select(F.lit("node").alias("kind"), F.col("node_type").alias("type"), F.col("name").alias("id")).unionByName(e.select(F.lit("edge").alias("kind"), "type", F.col("edge_id").alias("id")))


# texts and vectors


@query
def node_text(spark, d):
    return _nodes(spark, d, embedding.NODE).withColumn("evidence", F.lit(None).cast("string")).select("node_id", embedding.node_text().alias("text"))


@query
def edge_text(spark, d):
    return _edges(fx.er_rows(spark, d)).select("edge_id", embedding.edge_text().alias("text"))


@query
def embed_index(spark, d):
    embedded = embedding.embed_nodes(_nodes(spark, d, embedding.NODE).withColumn("evidence", F.lit(None).cast("string")), embedding.Embedder(dimension=64))
    return embedded.select("node_id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


def _vectors(spark, d):
    return fx.derive(spark, d, fx.NODE_VECTORS), fx.derive(spark, d, fx.EDGE_VECTORS), fx.vector_questions(spark, d)


_HIT = ["query_id", "rank", "vec_id", "node_type", "distance"]


@query
def vec_topk(spark, d):
    v, _, q = _vectors(spark, d)
    return vectors.top_k(v, q.where("query_id = 0"), 10).select(*_HIT)


@query
def vec_topk_batch(spark, d):
    v, _, q = _vectors(spark, d)
    return vectors.top_k(v, q, 10).select(*_HIT)


@query
def vec_topk_filtered_post(spark, d):
    v, _, q = _vectors(spark, d)
    return vectors.search(v, q, 10, F.col("node_type") == "L3").select(*_HIT)


@query
def vec_topk_filtered_pre(spark, d):
    v, _, q = _vectors(spark, d)
    return vectors.search(v, q, 10, F.col("node_type") == "L3", prefilter=True).select(*_HIT)


@query
def vec_edge_filtered(spark, d):
    _, e, q = _vectors(spark, d)
    return retrieval.edge_search(q, e, 10, F.lit("NEXT_L3")).select("query_id", "rank", "vec_id", "relationship_type", "distance")


@query
def vec_similarity_threshold(spark, d):
    v, _, q = _vectors(spark, d)
    return vectors.above_threshold(vectors.top_k(v, q, 20), 0.45).select("query_id", "vec_id", "similarity")


def _ivf(spark, d, **how):
    """All vectors but the last tenth are indexed, those are added, and the stored index is searched."""
    v, _, q = _vectors(spark, d)
    folder = _folder(spark, "ivf")
    late = F.col("vec_id") % 10 == 9
    ivf_pq.build(v.where(~late), folder)
    ivf_pq.add(v.where(late), folder)
    named = v.select("vec_id", "node_type")
    return ivf_pq.search(spark, folder, q.select("query_id", "query"), 10, **how).join(named, "vec_id").select(*_HIT)


@query
def vec_ann_ivf(spark, d):
    return _ivf(spark, d)


@query
def vec_ann_ivf_all_cells(spark, d):
    """Every cell, measured exactly: what exact search gives."""
    return _ivf(spark, d, probed=1.0, measured=None)


@query
def vec_stats(spark, d):
    return vectors.statistics(_vectors(spark, d)[0])


@query
def vec_lookup(spark, d):
    return vectors.lookup(_vectors(spark, d)[0], entity_name="Vec 7").select("vec_id", "node_type", "entity_name")


@query
def vec_add(spark, d):
    v, _, q = _vectors(spark, d)
    new = q.select(F.col("query_id").alias("ord"), F.col("query").alias("embedding"), F.lit("NEW").alias("node_type"), F.concat(F.lit("New "), F.col("query_id").cast("string")).alias("entity_name"))
    return vectors.add(v, new).select("vec_id", "node_type", "entity_name")


@query
def upsert_antijoin(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source", "lang")
    new = fx.table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("source"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang"))
    return vectors.upsert(docs, new, "doc_id")


@query
def delete_by_id(spark, d):
    return vectors.delete(fx.table(spark, d, "documents").select("doc_id", "source", "lang"), fx.table(spark, d, "labels").where("toxic = 1"), "doc_id")


# questions


def _parsed(spark):
    return questions.process(fx.questions(spark))


def _asked(spark, d):
    """Questions that grow with the tables, parsed."""
    return questions.process(fx.asked(spark, d))


@query
def question_intent(spark, d):
    return _asked(spark, d).select("query_id", "intent")


def _listed(name: str) -> Query:
    return lambda spark, d: _asked(spark, d).select("query_id", F.posexplode(name).alias("at", name))


for _name, _column in (("question_entities", "entities"), ("question_keywords", "keywords"), ("question_temporal", "temporal")):
    _f = _listed(_column)
    _f.__name__ = _name
    query(_f)


@query
def question_filters(spark, d):
    return _asked(spark, d).select("query_id", "node_type_filter", (F.size("temporal") > 0).alias("has_temporal"))


@query
def question_validate(spark, d):
    return questions.validate(_asked(spark, d), _nodes(spark, d))


# retrieval, context and answers


@query
def retrieve_vector(spark, d):
    v, e, q = _vectors(spark, d)
    return retrieval.vector(q, v, e).select("query_id", "kind", "rank", "id", "type", "score")


@query
def retrieve_graph(spark, d):
    nodes, edges = _graph(spark, d)
    return retrieval.by_graph(_parsed(spark), nodes, edges).select("query_id", "kind", "rank", "id", "type", "score")


@query
def retrieve_hybrid(spark, d):
    v, e, q = _vectors(spark, d)
    return retrieval.hybrid(q, v, e).select("query_id", "kind", "rank", "id", "type", "score", "final_score", "boost")


@query
def retrieve_adaptive_route(spark, d):
    return _asked(spark, d).select("query_id", "intent", "route")


@query
def retrieve_adaptive(spark, d):
    """The sample questions, each with a stored vector for its own."""
    nodes, edges = _graph(spark, d)
    v, e, _ = _vectors(spark, d)
    own = fx.table(spark, d, "embeddings").select((F.col("vec_id") / 2).alias("query_id"), F.col("embedding").alias("query"))
    asked = questions.process(fx.questions(spark)).join(own, "query_id")
    return retrieval.retrieve(cut(asked, "asked"), "adaptive", nodes, edges, v, e).select("query_id", "kind", "rank", "id", "method")


@query
def hybrid_expand(spark, d):
    v, e, q = _vectors(spark, d)
    edges = e.select("source", "target", F.col("relationship_type").alias("type"), F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("edge_id"))
    return retrieval.expand(edges, vectors.top_k(v, q, 10)).select("query_id", F.array_join("nodes", ";").alias("nodes"), "node_count", "edge_count")


@query
def retrieve_similar_and_related(spark, d):
    v, e, q = _vectors(spark, d)
    edges = e.select("source", "target", F.col("relationship_type").alias("type"), F.col("vec_id").cast("string").alias("edge_id"))
    return retrieval.similar_and_related(q, v, edges, threshold=0.45).select("query_id", "rank", "name", "similarity_score", "origin")


def _reranked(mode: str) -> Query:
    def f(spark, d):
        v, _, q = _vectors(spark, d)
        return retrieval.rerank(vectors.top_k(v, q, 20), "node", mode).select("query_id", "rank", "input_rank", "vec_id", "boost", "final_score")

    f.__name__ = f"rerank_boost_{mode}"
    return f


query(_reranked("distance"))
query(_reranked("similarity"))


@query
def rerank_boost_edges(spark, d):
    _, e, q = _vectors(spark, d)
    return retrieval.rerank(vectors.top_k(e, q, 20), "edge").select("query_id", "rank", "vec_id", "boost", "final_score")


@query
def context_entities(spark, d):
    v, e, q = _vectors(spark, d)
    return context.entities(retrieval.hybrid(q, v, e)).select("query_id", "rank", "name", "type", "score", "boost")


@query
def context_sources(spark, d):
    v, e, q = _vectors(spark, d)
    return context.sources(retrieval.vector(q, v, e)).select("query_id", F.array_join("sources", ";").alias("sources"))


@query
def context_graph_text(spark, d):
    nodes, edges = _graph(spark, d)
    rows = cut(retrieval.by_graph(_parsed(spark), nodes, edges), "retrieved")
    return context.assemble(fx.questions(spark), rows, "graph").select("query_id", "context_text", "entity_count", "relationship_count", "token_count")


def _vector_edges(e: DataFrame) -> DataFrame:
    """Edge vectors as a graph's edges."""
    edge_id = F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 12, "0"))
    return e.select("source", "target", F.col("relationship_type").alias("type"), edge_id.alias("edge_id"))


def _contexts(spark, d, layout: str) -> DataFrame:
    v, e, q = _vectors(spark, d)
    if layout == "vector":
        return context.assemble(q, cut(retrieval.vector(q, v, e), "retrieved"), layout)
    rows = cut(retrieval.hybrid(q, v, e), "retrieved")
    hits = rows.where("kind = 'node'").select("query_id", "rank", F.col("name").alias("entity_name"))
    return context.assemble(q, rows, layout, cut(retrieval.expand(_vector_edges(e), hits), "around"))


@query
def context_vector_text(spark, d):
    return _contexts(spark, d, "vector").select("query_id", "context_text", "token_count")


@query
def context_hybrid_text(spark, d):
    return _contexts(spark, d, "hybrid").select("query_id", "context_text", "token_count")


@query
def context_truncate(spark, d):
    return context.truncate(_contexts(spark, d, "vector"), 200).select("query_id", "truncated", "context_text", "token_count")


@query
def answer_confidence(spark, d):
    return _contexts(spark, d, "vector").select("query_id", answers.confidence().alias("confidence"))


@query
def answer_prompt(spark, d):
    return _contexts(spark, d, "vector").select("query_id", answers.prompt().alias("prompt"), answers.citation_prompt().alias("citation_prompt"))


@query
def answer_citations(spark, d):
    """A client that counts its prompt's characters stands in for a model."""
    answered = answers.generate(_contexts(spark, d, "hybrid"), lambda prompt: f"{len(prompt)} characters", citations=True)
    return answered.select("query_id", "answer", "confidence", F.array_join("sources", ";").alias("sources"))


@query
def answer_offline(spark, d):
    return answers.generate(_contexts(spark, d, "vector")).select("query_id", "answer", "confidence", F.size("sources").alias("n_sources"))


# files: tables written to the shared folder as files, and read back


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"


def _texts(spark, d) -> str:
    """One text file for each source: its documents, one after another."""
    folder = _folder(spark, "texts")
    docs = fx.table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(folder)
    return folder


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("file_type", F.md5("content").alias("digest"), F.length("content").alias("n_chars"), "size", "row_count")


@query
def load_text(spark, d):
    return _read(files.text(spark, f"{_texts(spark, d)}/*/*.txt"))


@query
def load_markdown(spark, d):
    return _read(files.markdown(spark, f"{_texts(spark, d)}/*/*.txt"))


@query
def load_json(spark, d):
    """A list of its customers for each nation, an object for the first of each, a number for each region, and something else."""
    customer, region = fx.table(spark, d, "customer"), fx.table(spark, d, "region")
    one = F.struct("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("j"))
    lists = customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(one)).alias("x"))
    objects = lists.select(F.col("x")[0]["j"].alias("value"))
    lists = lists.select(F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["j"]), ","), F.lit("]")).alias("value"))
    rest = region.select(F.col("r_regionkey").cast("string").alias("value")).union(region.select(F.concat("r_name", F.lit(" is not JSON"))))
    folder = _folder(spark, "json")
    for k, table in enumerate((lists, objects, rest)):
        n = table.count()
        table.withColumn("__n", F.row_number().over(W.orderBy("value"))).repartition(n, "__n").write.partitionBy("__n").text(f"{folder}/{k}")
    return files.json_files(spark, f"{folder}/*/*/*.txt").select("file_type", "content")


@query
def load_csv(spark, d):
    folder = _folder(spark, "csv")
    fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(folder)
    rows = files.csv_rows(spark, f"{folder}/*.csv", multiline=False)
    last = rows.groupBy("source_doc").agg(F.count("*").alias("n"), F.max("row_index").alias("last"), F.countDistinct("row_index").alias("different"))
    gapless = last.agg(F.every((F.col("n") == F.col("last") + 1) & (F.col("n") == F.col("different"))).alias("gapless"))
    return rows.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").join(F.broadcast(gapless))  # one row


@query
def load_csv_document(spark, d):
    folder = _folder(spark, "csv")
    own = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    own.repartition(1).sortWithinPartitions("c_custkey").write.option("header", True).csv(folder)  # a document is one file
    return files.csv_files(spark, f"{folder}/*.csv").select("file_type", "content", "row_count")


@query
def load_directory(spark, d):
    """Text and CSV files and one that isn't JSON, in folders below one; files that don't fit the pattern stay out."""
    root = _folder(spark, "directory")
    customer = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    for k in range(5):
        own = customer.where(F.col("c_nationkey") % 5 == k).repartition(1).sortWithinPartitions("c_custkey")
        own.select("c_name").write.text(f"{root}/{k}/text")
        own.write.option("header", True).csv(f"{root}/{k}/csv")
        own.select("c_name").write.json(f"{root}/{k}/json")
    found = files.Ingestion().load_directory(spark, root, "part-*", recursive=True)
    return found.groupBy("file_type").agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("n_chars"), F.sum("row_count").alias("row_count"))


@query
def json_sinks(spark, d):
    """Entity counts, written as lines and as a list, read again."""
    folder = _folder(spark, "sink")
    counts = E.summary(E.dedup(E.row_entities(fx.er_rows(spark, d))))
    tables.write_json(counts, f"{folder}/lines")
    tables.write_json_list(spark.read.json(f"{folder}/lines").select("type", "n"), f"{folder}/list.json")
    both = spark.read.json(f"{folder}/lines").select(F.lit("lines").alias("sink"), "type", "n")
    return both.union(spark.read.json(f"{folder}/list.json", multiLine=True).select(F.lit("list").alias("sink"), "type", "n"))


@query
def json_docs_to_text(spark, d):
    return fx.table(spark, d, "events").select("event_id", files.json_text(F.col("props")).alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question end to end: rows, entities, relationships, graph, traversal, context."""
    return context_graph_text(spark, sf_dir)
