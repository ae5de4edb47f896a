"""Queries of what is written and read again: sinks, stores, factories and injected models, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut
from skeinwork.operators import chunking, embedding, graph, retrieval, vectors
from skeinwork.operators import entities as E
from skeinwork.operators import relations as R
from skeinwork.plans import jobs
from skeinwork.plans.queries import ENTITY_OUT, _counted, _docs, _er, _folder, _graph, _stored_rows, _vectors, query
from skeinwork.sources import files, tables
from skeinwork.sources import fixtures as fx

# sinks


@query
def sink_entities(spark, d):
    """Unique entities as JSON lines, read again."""
    folder = _folder(spark, "sink")
    found = E.dedup(E.row_entities(fx.er_rows(spark, d)))
    tables.write_json(found, folder)
    return spark.read.schema(found.schema).json(folder).select(*ENTITY_OUT)


@query
def sink_relations(spark, d):
    folder = _folder(spark, "sink")
    found = R.dedup(_er(spark, d)[2])
    tables.write_json(found, folder, "gzip")
    return spark.read.schema(found.schema).json(folder).select("ord", "source", "target", "type", "confidence")


@query
def sink_statistics(spark, d):
    """What a finished job says of its graph: the totals, as a list in one file, read again."""
    folder = _folder(spark, "sink")
    tables.write_json_list(graph.statistics(*_counted(spark, d)).orderBy("kind", "name"), f"{folder}/graph_statistics.json")
    return spark.read.schema("kind string, name string, n long").json(f"{folder}/graph_statistics.json", multiLine=True)


@query
def sink_answers(spark, d):
    """Answers (here: the questions themselves) as JSON lines, and the statistics of the index beside them."""
    folder = _folder(spark, "sink")
    v, e, _ = _vectors(spark, d)
    asked = fx.asked(spark, d).select("query_id", F.col("question").alias("answer"))
    jobs.write_results(folder, asked, v, e)
    stats = spark.read.json(f"{folder}/indexing_stats.json", multiLine=True).select(F.col("store").alias("name"), F.col("total_vectors").alias("n"))
    return spark.read.schema(asked.schema).json(f"{folder}/qa_results").select(F.col("answer").alias("name"), F.col("query_id").alias("n")).union(stats)


# stores


@query
def store_vectors(spark, d):
    """Vectors saved, loaded, cleared and not found again."""
    folder = _folder(spark, "vectors")
    v, _, _ = _vectors(spark, d)
    tables.save_vectors(v, f"{folder}/kept")
    tables.save_vectors(v, f"{folder}/gone")
    tables.clear_vectors(spark, f"{folder}/gone")
    assert tables.load_vectors(spark, f"{folder}/gone") is None
    return tables.load_vectors(spark, f"{folder}/kept").select("vec_id", "node_type", "entity_name", F.size("embedding").alias("dimension"))


@query
def store_graph(spark, d):
    """The graph persisted by types and loaded, and what is left of a cleared one."""
    folder = _folder(spark, "graph")
    nodes, edges = _graph(spark, d)
    graph.persist(nodes, edges, f"{folder}/kept")
    graph.persist(nodes, edges, f"{folder}/gone")
    graph.clear(*graph.load(spark, f"{folder}/kept"), f"{folder}/gone")
    n, e = graph.load(spark, f"{folder}/kept")
    left = [x.groupBy().agg(F.count("*").alias("n")).select(F.lit("cleared").alias("part"), F.lit(name).alias("type"), "n") for name, x in zip(("nodes", "edges"), (spark.read.schema(n.schema).parquet(f"{folder}/gone/nodes"), spark.read.schema(e.schema).parquet(f"{folder}/gone/edges")))]
    found = n.groupBy(F.lit("nodes").alias("part"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    return found.union(e.groupBy(F.lit("edges").alias("part"), "type").agg(F.count("*").alias("n"))).union(left[0]).union(left[1])


def _indexed(spark, d):
    """The graph with what texts are made of, and its vector stores."""
    nodes, edges = _graph(spark, d, embedding.NODE, ("ord", "source", "type", "target", "section", "year", "evidence"))
    return nodes, edges, jobs.index_graph(nodes, edges, embedding.Embedder(dimension=16), _folder(spark, "index"))


@query
def index_graph(spark, d):
    """Nodes and edges with their texts in the vector stores, numbered without gaps."""
    _, _, (n, e) = _indexed(spark, d)
    parts = [x.select(F.lit(name).alias("store"), F.col(key).alias("id"), "text", (F.size("embedding") == 16).alias("embedded"), "vec_id") for name, key, x in (("nodes", "node_id", n), ("edges", "edge_id", e))]
    both = parts[0].union(parts[1])
    # a row for each store; joined by the store, all rows of one would be one task's
    gaps = both.groupBy(F.col("store").alias("of")).agg(((F.count("*") == F.max("vec_id") + 1) & (F.countDistinct("vec_id") == F.count("*"))).alias("gapless"))
    return both.join(F.broadcast(gaps), both["store"] == gaps["of"]).select("store", "id", "text", "embedded", "gapless")


@query
def index_statistics(spark, d):
    """What the job says of both stores, and whether retrieval finds them."""
    _, _, (n, e) = _indexed(spark, d)
    ready = retrieval.statistics(n, e)["hybrid_store_indexed"] and jobs.hybrid_statistics(n, e)["indexed"]
    return jobs.index_statistics(n, e).select("store", "total_vectors", "dimension", F.lit(ready).alias("ready"))


@query
def embed_statistics(spark, d):
    nodes, edges = _graph(spark, d)
    e = embedding.Embedder(dimension=16)
    return embedding.embedding_statistics(embedding.embed_nodes(nodes.withColumn("evidence", F.lit(None).cast("string")), e), embedding.embed_edges(edges, e))


# factories and injected models


@query
def chunker_factory(spark, d):
    """Each strategy by its name: how many chunks, and how long."""
    docs = _docs(spark, d)
    parts = [chunking.chunker(s)(docs.withColumn("text", F.regexp_replace("text", "\n", "\n\n")) if s == "semantic" else docs) for s in ("fixed", "sentence", "semantic")]
    parts = [p.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars")) for p in parts]
    return parts[0].union(parts[1]).union(parts[2])


@query
def extractor_factories(spark, d):
    """Extractors by their names, over rows and texts."""
    rows, chunks = _stored_rows(spark, d), fx.text_chunks(spark, d)
    found = E.extractor("csv")(rows)
    kinds = {"entities csv": found, "entities keyword": E.extractor("keyword")(chunks), "relations csv": R.extractor("csv")(rows, E.dedup(found.select(*R.TYPED))), "relations pattern": R.extractor("pattern")(chunks)}
    out = None
    for name, table in kinds.items():
        one = table.groupBy(F.lit(name).alias("extractor"), "type").agg(F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def _echo(prompts: list[str]) -> list[str]:
    """A stand-in for a model: it names the first word of the text in its prompt, and says how many letters it has."""
    out = []
    for p in prompts:
        word = p.split("\n\nText:\n", 1)[1].split("\n\nAnswer with", 1)[0].split()[0]
        out.append(f"Thinking...\nENTITY: {word} | TYPE: word{len(word)} | CONFIDENCE: 0.5")
    return out


@query
def llm_entities(spark, d):
    """Entities from a model (injected; here one that names the first word) over all texts."""
    return E.model_entities(fx.text_chunks(spark, d), _echo, ["PERSON", "WORD"]).select("chunk_id", "text", "type", "confidence", "extraction_method")


@query
def llm_prompts(spark, d):
    return fx.text_chunks(spark, d).select("chunk_id", F.md5(E.model_prompt(F.col("text"), ["PERSON", "ORGANIZATION"])).alias("digest"))


@query
def chunk_nodes_without_ids(spark, d):
    """Chunks of every third text have lost their ids: they get one that says what they are."""
    chunks = fx.text_chunks(spark, d)
    lost = F.pmod(F.length("text"), F.lit(3)) == 0
    return graph.chunk_nodes(chunks.withColumn("chunk_id", F.when(~lost, F.col("chunk_id")))).select("node_id", F.col("source"))


@query
def loader_of_ones_own(spark, d):
    """Event logs by a loader that a user adds for their ending: each file a document of its lines."""
    root = _folder(spark, "logs")
    fx.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat_ws(" ", "event_id", "event_type").alias("value"), "event_id").repartition("kind").sortWithinPartitions("kind", "event_id").select("kind", "value").write.partitionBy("kind").text(root)
    ingest = files.Ingestion()

    def load(session, paths) -> DataFrame:
        lines = session.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("source"))
        kind = F.regexp_extract("source", "kind=([^/]+)", 1)
        return lines.select(kind.alias("doc_id"), F.col("value").alias("content"), "source", F.lit(None).cast("string").alias("filename"), F.lit("log").alias("file_type"), F.length("value").alias("size"), F.regexp_count("value", F.lit("\n")).alias("row_count"))

    ingest.add_loader(".txt", load)
    return ingest.load_directory(spark, root, "part-*", recursive=True).select("doc_id", "file_type", F.md5("content").alias("digest"), "row_count")


@query
def vector_store_statistics(spark, d):
    """Two stores by what they hold, before and after vectors are added."""
    v, _, q = _vectors(spark, d)
    new = q.select(F.col("query_id").alias("ord"), F.col("query").alias("embedding"), F.lit("NEW").alias("node_type"), F.lit("x").alias("entity_name"))
    both = [vectors.statistics(x).withColumn("state", F.lit(s)) for s, x in (("before", v), ("after", vectors.add(v, new)))]
    return both[0].unionByName(both[1])
