"""A stored graph that is looked up by name and walked from node to node without moving its edges.

`ends` has every edge from either end, bucketed and sorted by that end, so a join of reached nodes with it shuffles the reached nodes
alone. `names` has the nodes bucketed and sorted by name, with Bloom filters, so a lookup reads one bucket and skips its row groups.

A node of many edges (a hub) would make one bucket as large as all its edges: its edges are dealt to `part`s of PART edges each, which
are other buckets, and `hubs` says how many there are. Reached hubs meet all their parts.

Tables are Parquet in a folder; where they are opened they get names of their own in the session's catalogue, which know the buckets.
Null names and edges without either end are in no bucket that a lookup or a walk could ask for, and are left out of `ends`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import graph

#: Buckets of a table; edges of a part of a hub, about.
BUCKETS, PART = 64, 100_000


@dataclass(frozen=True)
class Index:
    """nodes; ends: a, part and the edge's columns; hubs: a, parts; tables: the names in the catalogue."""

    nodes: DataFrame
    ends: DataFrame
    hubs: DataFrame
    tables: tuple[str, ...]

    def meet(self, reached: DataFrame) -> DataFrame:
        """reached (node and more) with b and edge for each edge at its nodes."""
        hubs = self.hubs.withColumnRenamed("a", "hub")
        parts = reached.join(hubs, reached["node"] == hubs["hub"], "left").withColumn("of", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        parts = parts.drop("hub", "parts")
        edge = F.struct("source", "target", "type", "edge_id").alias("edge")
        met = parts.join(self.ends, (parts["node"] == self.ends["a"]) & (parts["of"] == self.ends["part"]))
        return met.select(*reached.columns, F.when(F.col("a") == F.col("source"), F.col("target")).otherwise(F.col("source")).alias("b"), edge)

    def by_name(self, name: str) -> DataFrame:
        return graph.get_entity(self.nodes, name)

    def close(self) -> None:
        """Forgets the tables' names; the files stay."""
        for name in self.tables:
            self.nodes.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _store(df: DataFrame, path: str, keys: list[str], buckets: int, more: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> None:
    """A bucketed table of one file a bucket. The writer sorts; `more` is what rows are given behind the shuffle."""
    name = f"index_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    (more(dealt) if more else dealt).write.format("parquet").options(**options).option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def _opened(spark: SparkSession, path: str, keys: list[str], buckets: int) -> tuple[DataFrame, str]:
    name = f"index_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(keys)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name), name


def build(nodes: DataFrame, edges: DataFrame, folder: str, buckets: int = BUCKETS, part: int = PART) -> None:
    """Stores nodes (node_id, node_type, name and more) and edges (source, target, type, edge_id) in a folder that is new."""
    # an end's row names both ends once until it is where it stays: `out` tells which is the source; there the other end is told by `a`
    ends = graph.both_ways(edges.where("source is not null and target is not null")).select("a", "b", (F.col("a") == F.col("edge.source")).alias("out"), "edge.type", "edge.edge_id")
    hubs = ends.groupBy("a").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    hubs.write.parquet(f"{folder}/hubs")
    hubs = nodes.sparkSession.read.schema("a string, parts int").parquet(f"{folder}/hubs").withColumnRenamed("a", "hub")
    # few are hubs; joined by the end, as many edges as a hub has would be one task's again, so their list is broadcast if Spark finds it small, else dealt by skew
    dealt = ends.join(hubs, ends["a"] == hubs["hub"], "left").withColumn("part", F.pmod(F.xxhash64("edge_id", "b"), F.coalesce("parts", F.lit(1))).cast("int"))
    source, target = F.when(F.col("out"), F.col("a")).otherwise(F.col("b")), F.when(F.col("out"), F.col("b")).otherwise(F.col("a"))
    named = lambda df: df.select("a", "part", source.alias("source"), target.alias("target"), "type", "edge_id")
    _store(dealt.select("a", "part", "b", "out", "type", "edge_id"), f"{folder}/ends", ["a", "part"], buckets, named)
    _store(nodes, f"{folder}/names", ["name"], buckets, **{"parquet.bloom.filter.enabled#name": "true"})
    nodes.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> Index:
    """The index of a folder, in any session."""
    buckets = spark.read.schema("buckets int").json(f"{folder}/about").first()["buckets"]
    nodes, names = _opened(spark, f"{folder}/names", ["name"], buckets)
    ends, walks = _opened(spark, f"{folder}/ends", ["a", "part"], buckets)
    return Index(nodes, ends, spark.read.schema("a string, parts int").parquet(f"{folder}/hubs"), (names, walks))
