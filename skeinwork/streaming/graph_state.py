"""A graph that follows a stream: degrees and nodes are kept by key in the stream's state, and each batch writes the keys that changed.

The state is that of Spark's own streaming aggregation (counts, and for each property the last value that isn't null), so a batch costs
its own rows and their keys, whatever came before, and any split of the input into batches ends with the same rows. A batch writes
the changed keys as a partition of its own; a batch that runs again overwrites that partition alone. Readers take the last row of a key.

Order is a column (`ord`), not arrival: late rows find their place. State is kept on disk (RocksDB) and in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.functions.storage import exists
from skeinwork.operators import graph

STATE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, files: int = 64) -> StreamingQuery:
    """Streams the Parquet files of a folder through an aggregation until all are read; the rows that a batch changed go to the store.
    work: from rows to one row a key, as graph.degrees and graph.upsert_nodes do it."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    before = spark.conf.get(STATE[0], None)
    try:
        spark.conf.set(*STATE)
        return work(arriving).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE[0]) if before is None else spark.conf.set(STATE[0], before)


def degrees(spark: SparkSession, folder: str, store: str, checkpoint: str, files: int = 64) -> StreamingQuery:
    """Edges (source, target) as they come, into degrees by node."""
    return follow(spark, folder, "source string, target string", graph.degrees, store, checkpoint, files)


def nodes(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, files: int = 64) -> StreamingQuery:
    """Entities as they come, into nodes by type and name whose properties are the last that aren't null."""
    return follow(spark, folder, schema, graph.upsert_nodes, store, checkpoint, files)


def current(spark: SparkSession, store: str, *key: str) -> DataFrame | None:
    """The last row of each key; None before the first batch."""
    if not exists(spark, store):
        return None
    rows = spark.read.parquet(store)
    names = [c for c in rows.columns if c != "batch"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in names if c not in key]), "batch").alias("row"))
    return last.select(*[F.col(c) if c in key else F.col("row").getField(c).alias(c) for c in names])
