"""New documents as a stream: each batch of files becomes entities that are merged into a stored table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.functions.storage import exists, remove
from skeinwork.operators import entities as E

#: Parts of a store beyond which they are merged into one.
PARTS = 16


class EntityStore:
    """Entities in a folder: a list of parts and a Parquet table for each. A batch writes its own entities alone; readers merge the parts
    (one entity for each type and normalised text, the earlier first). A part is named by its stream and batch and listed after it is
    written, so a batch that is run again replaces or repeats itself, which changes nothing. Parts are merged when they are many."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def parts(self) -> list[str]:
        if not exists(self.spark, f"{self.folder}/parts"):
            return []
        return [r["value"] for r in self.spark.read.text(f"{self.folder}/parts").collect()]  # PARTS or so

    def _list(self, names: list[str]) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        new, old = fs.Path(f"{self.folder}/parts-new"), fs.Path(f"{self.folder}/parts")
        system = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = system.create(new, True)
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        context = fs.FileContext.getFileContext(old.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        context.rename(new, old, options)

    def read(self) -> DataFrame | None:
        names = self.parts()
        if not names:
            return None
        found = self.spark.read.parquet(*[f"{self.folder}/{n}" for n in names])
        return E.dedup(found) if len(names) > 1 else found

    def add(self, entities: DataFrame, name: str, most: int = PARTS) -> None:
        E.dedup(entities).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        names = [n for n in self.parts() if n != name] + [name]
        self._list(names)
        if len(names) > most:
            whole = f"merged-{hashlib.md5(name.encode()).hexdigest()[:12]}"
            self.read().write.mode("overwrite").parquet(f"{self.folder}/{whole}")
            self._list([whole])
            for n in names:
                remove(self.spark, f"{self.folder}/{n}")


def entity_stream(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Runs over Parquet files (chunk_id, source_doc, ord, text) as they come, until the folder is read, into an EntityStore."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, epoch: int) -> None:
        EntityStore(spark, store).add(E.keyword_entities(batch), f"{stream}-{epoch}", parts)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts and sums of events by type over sliding windows, with a watermark."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
