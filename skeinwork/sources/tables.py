"""Where results go: JSON files, Parquet stores of vectors, and stores that are read again if they are there."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.storage import exists, remove


def write_json(df: DataFrame, folder: str, compression: str = "none") -> None:
    """Entities, relationships, statistics or answers, one JSON object a line; compression: as Spark names it, for tables that are large (gzip: part-*.json.gz)."""
    df.write.mode("overwrite").json(folder, compression=compression)


def write_json_list(df: DataFrame, path: str) -> None:
    """One file with an indented JSON list, for summaries of some rows: they are drawn to the driver, which holds one partition at a time. Whatever grows
    with the input goes to write_json."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        opening = "["
        for (row,) in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
            text = json.dumps(json.loads(row), indent=2, ensure_ascii=False)
            out.write(bytearray((opening + "\n  " + text.replace("\n", "\n  ")).encode()))
            opening = ","
        out.write(bytearray(("[]" if opening == "[" else "\n]").encode()))
    finally:
        out.close()


def save_vectors(df: DataFrame, folder: str) -> None:
    """Vectors and their metadata as columns of one table."""
    df.write.mode("overwrite").parquet(folder)


def load_vectors(spark: SparkSession, folder: str) -> DataFrame | None:
    """The stored vectors, or None if there are none: they are to be made then."""
    return spark.read.parquet(folder) if exists(spark, f"{folder}/_SUCCESS") else None


def clear_vectors(spark: SparkSession, folder: str) -> None:
    """The store and its vectors go."""
    remove(spark, folder)
