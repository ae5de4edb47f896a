"""Incremental job: what was asked in conversations, parsed and routed, as a log that each run carries on.

    python -m jobs.question_log --conversations s3a://.../conversations --output s3a://.../questions --checkpoint s3a://.../state [--config jobs/question_log.json]

Reads the Parquet files (of a folder, a pattern or one file) of conversations (conv_id, turn, role, text) that earlier runs have not seen, as a file stream with a
checkpoint, and ends when all are read. Writes

    questions/batch=.../route=...   conv_id, turn, question, intent, entities, keywords, temporal, node_type_filter, known
    counts/batch=...                route, intent, node_type_filter, n_questions, n_conversations

Counts of a batch are made of its questions and are summed when read, so old batches are never read again for new ones. A conversation
that goes on in a later batch is one more there.

Config: files_in_batch; roles: whose turns are questions; graph: the output of jobs.build_graph, or null. With a graph `known` lists which of a
question's entities are its nodes, as the graph is when the batch runs: a question about none of them can't be answered by walking it.

A turn that comes again in a later file (equal in all four columns) is not taken again: the stream keeps the hashes of what it has
taken, in its checkpoint, spread over the shuffle partitions of the first run and held on disk. A turn whose text was changed is a
new one. A batch that is run again after a failure overwrites its own partitions alone, so each question is there once. Turns
without a text are no questions; null ids and turns are values like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_graph
from jobs.common import command_line, described, log, settings
from skeinwork.functions.storage import cut, exists, scope
from skeinwork.operators import questions

CONFIG = {"files_in_batch": 64, "roles": ["user"], "graph": None}
SCHEMA = "conv_id long, turn long, role string, text string"
QUESTIONS = "conv_id long, turn long, question string, intent string, entities array<string>, keywords array<string>, temporal array<string>, node_type_filter string, known array<string>, batch long, route string"
COLUMNS = ["conv_id", "turn", "question", "intent", "entities", "keywords", "temporal", "node_type_filter", "route"]
COUNTS = "route string, intent string, node_type_filter string, n_questions long, n_conversations long, batch long"
#: State on disk instead of in memory: it grows with all turns.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def parsed(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, text) as questions with their parts and the route that answers them."""
    return questions.process(turns.withColumnRenamed("text", "question")).select(*COLUMNS)


def with_known(asked: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Questions (key, entities and more) with those of their entities that are nodes. Names are joined once each, however many ask about them."""
    if nodes is None:
        return asked.withColumn("known", F.lit(None).cast("array<string>"))
    named = asked.select("key", F.explode("entities").alias("name"))
    there = named.select("name").distinct().join(nodes.where("node_type <> 'CHUNK'").select(F.col("node_id").alias("name")).distinct(), "name", "left_semi")
    of = named.join(there, "name").groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("known"))
    return asked.join(of, "key", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that df has, and leaves all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, conversations: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes what is new; returns the whole log as it stands then (`stored`)."""
    chosen = {**CONFIG, **(config or {})}

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        with scope(session):
            nodes = None
            if chosen["graph"]:
                # read more than once below, and a stream's batch is to be run once
                batch, nodes = cut(batch, "question-batch"), build_graph.tables(session, chosen["graph"])[0]
            asked = questions.process(batch.withColumnRenamed("text", "question")).withColumn("key", F.struct("h1", "h2"))
            asked = with_known(asked, nodes).select(*COLUMNS, "known", F.lit(number).cast("long").alias("batch"))
            _replace(asked, f"{output}/questions", "batch", "route")
        own = session.read.schema(QUESTIONS).parquet(f"{output}/questions").where(F.col("batch") == number)
        # conversations are counted in two steps, so that a long one is counted before it is shuffled
        each = own.groupBy("route", "intent", "node_type_filter", "conv_id").agg(F.count("*").alias("n"))
        counts = each.groupBy("route", "intent", "node_type_filter").agg(F.sum("n").alias("n_questions"), F.count("*").alias("n_conversations"))
        _replace(counts.withColumn("batch", F.lit(number).cast("long")), f"{output}/counts", "batch")
        log.info("batch %d: %d questions", number, own.count())

    # as a pattern the path may name a folder or a single file
    pattern = conversations if any(c in conversations for c in "*?[{") else f"{conversations.rstrip('/')[:-1]}[{conversations.rstrip('/')[-1]}]"
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", chosen["files_in_batch"]).parquet(pattern)
    asked = arriving.where(F.col("role").isin(chosen["roles"]) & F.col("text").isNotNull())
    # two hashes stand for a turn in the state, so that it holds no texts
    columns = ["conv_id", "turn", "role", "text"]
    keys = {"h1": F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]), "h2": F.xxhash64(F.lit(7), *columns, *[F.col(c).isNull() for c in columns])}
    asked = asked.withColumns(keys).dropDuplicates(["h1", "h2"])
    with settings(spark, STATE):
        stream = asked.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        stream.awaitTermination()
    log.info("read %d new turns in %d batches, %s", sum(p["numInputRows"] for p in stream.recentProgress), sum(1 for p in stream.recentProgress if p["numInputRows"]), conversations)
    return described(stored(spark, output), "log holds questions", f"{output}/questions")


def stored(spark: SparkSession, output: str) -> DataFrame:
    """All questions so far."""
    return _read(spark, f"{output}/questions", QUESTIONS)


def totals(spark: SparkSession, output: str) -> DataFrame:
    """route, intent, node_type_filter, n_questions, n_conversations over all batches."""
    found = _read(spark, f"{output}/counts", COUNTS)
    return found.groupBy("route", "intent", "node_type_filter").agg(F.sum("n_questions").alias("n_questions"), F.sum("n_conversations").alias("n_conversations"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


if __name__ == "__main__":
    command_line("question_log", ["conversations", "output", "checkpoint"], "jobs/question_log.json", run)
