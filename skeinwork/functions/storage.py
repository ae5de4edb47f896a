"""Tables that cut lineage: written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that have none set, by application; and the tables of the scopes that are open.
_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets its own
    temporary one, which goes with the process; on a cluster that raises, as executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="skeinwork-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later stages don't repeat the work, and a lost executor loses none of it."""
    return cut_all([df], name)


def cut_all(tables: Iterable[DataFrame], name: str) -> DataFrame:
    """All rows of tables of one schema, written one after another and read as one."""
    path = spark = schema = None
    for df in tables:
        spark, schema = df.sparkSession, df.schema
        path = path or _path(spark, name)
        df.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are deleted at the end. For jobs that store their results inside too: what is read of them later is gone."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)
