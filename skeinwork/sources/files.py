"""Documents from files: text, Markdown, JSON and CSV, one by one or by folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.text import path_name

#: doc_id, content, source, filename, file_type, size, row_count
SCHEMA = "doc_id string, content string, source string, filename string, file_type string, size int, row_count int"


def _shape(df: DataFrame, kind: str) -> DataFrame:
    have = df.columns
    given = {"file_type": F.lit(kind), "filename": path_name(F.col("source")), "doc_id": F.col("source")}
    fields = [f.split(" ") for f in SCHEMA.split(", ")]
    return df.select(*[(F.col(n) if n in have else given.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields])


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # a file that is gone or can't be read is passed over
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.text(path, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source"))


def text(spark: SparkSession, path: str | list[str], kind: str = "text") -> DataFrame:
    """Whole files; size in code points."""
    return _shape(_whole(spark, path).withColumn("size", F.length("content")), kind)


def markdown(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return text(spark, path, "markdown")


def pretty_json(raw: str) -> str | None:
    """An object in indented form, a list's items so with blank lines between, a scalar as it prints; None if it isn't JSON."""
    try:
        data = json.loads(raw)
    except ValueError:
        return None
    if isinstance(data, dict):
        return json.dumps(data, indent=2)
    return "\n\n".join(json.dumps(x, indent=2) for x in data) if isinstance(data, list) else str(data)


def json_text(raw: Column) -> Column:
    """pretty_json() of a column."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else pretty_json(x))

    return text(raw)


def json_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files as indented text; files that aren't JSON are left out."""
    return _shape(_whole(spark, path).withColumn("content", json_text(F.col("content"))).where("content is not null"), "json")


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line of a CSV file ends inside a quoted cell, if it begins so or not. Quotes are doubled inside; elsewhere than at a cell's begin they are characters."""
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            while close >= 0 and line[close + 1 : close + 2] == '"':
                close = line.find('"', close + 2)
            if close < 0:
                return True
            at = close + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at, inside = line.find(",", at) + 1, False
        if not at:
            return False


def line_states(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
    """For each line whether it begins inside a quoted cell, and whether the last one ends so. Only lines with a quote are looked at."""
    out = np.zeros(len(lines), bool)
    done = 0
    for k in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
        out[done : k + 1] = inside
        inside, done = ends_inside(lines[int(k)].as_py(), inside), k + 1
    out[done:] = inside
    return out, inside


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one split of a file: ((path, start), lines). Lines come as value, path, start."""
    for batch in batches:
        starts, paths = batch.column(2).to_numpy(), batch.column(1)
        last = np.flatnonzero((starts[1:] != starts[:-1]) | pc.not_equal(paths[1:], paths[:-1]).to_numpy(zero_copy_only=False)) + 1
        for lo, hi in zip([0, *last], [*last, batch.num_rows]):
            if hi > lo:
                yield (paths[int(lo)].as_py(), int(starts[lo])), batch.column(0)[int(lo) : int(hi)]


def _full(lines: pa.Array) -> np.ndarray:
    """Which lines hold anything but their own carriage return."""
    return pc.greater(pc.binary_length(pc.utf8_rtrim(lines, "\r")), 0).to_numpy(zero_copy_only=False)


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a split's lines: whether it ends inside a quoted cell, and how many rows begin in it, if it begins outside and if inside."""
    for nth, ((path, start), lines) in enumerate(_by_split(batches)):
        found = []
        for inside in (False, True):
            states, end = line_states(lines, inside)
            found += [end, int((~states & _full(lines)).sum())]
        yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "nth": nth, "end0": found[0], "n0": found[1], "end1": found[2], "n1": found[3]}])


def _raw_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_doc, nth, raw: the rows of CSV files as text, with line breaks in quoted cells, numbered in each file from 0. Empty lines are no rows.

    Files are read split by split, twice. The first time each split tells what it does to the state it begins in (outside or inside a quoted
    cell), which is known when all splits before have told; that, a row for each split, is worked out on the driver, which has the list of
    splits anyway. The second time every split gives its rows; only those that go over a border come in pieces and meet. A quote that is never closed takes the rest of its file.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    lines = reader.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    told = lines.mapInArrow(_split_ends, "path string, start long, nth long, end0 boolean, n0 long, end1 boolean, n1 long").collect()
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    file, inside, rows = None, False, 0
    for r in sorted(told, key=lambda r: (r["path"], r["start"], r["nth"])):
        if r["path"] != file:
            file, inside, rows = r["path"], False, 0
        begins.setdefault((r["path"], r["start"]), (inside, rows))
        rows, inside = rows + r["n1" if inside else "n0"], r["end1" if inside else "end0"]
    shared = spark.sparkContext.broadcast(begins)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, rows = None, False, 0
        for at, found in _by_split(batches):
            if at != now:
                now, (inside, rows) = at, shared.value[at]
            states, inside = line_states(found, inside)
            full = _full(found)
            own = np.cumsum(~states & full) + rows - 1
            rows, full = int(own[-1]) + 1, full | states
            # rows of one line, none of which is a first or last one here, are whole; of the others each line is a piece
            first, n = np.unique(own[full], return_counts=True)
            whole = np.isin(own, first[(n == 1) & (first > own[0]) & (first < own[-1])]) & full
            piece = np.where(whole, -1, np.arange(len(own)))
            keep = pa.array(np.flatnonzero(full))
            cols = [pa.array(np.full(len(keep), at[0], object), pa.string()), pa.array(own[full]), pa.array(np.full(len(keep), at[1])), pa.array(piece[full]), found.take(keep)]
            yield pa.RecordBatch.from_arrays(cols, names=["source_doc", "nth", "start", "piece", "raw"])

    pieces = lines.mapInArrow(give, "source_doc string, nth long, start long, piece long, raw string").withColumn("at", F.monotonically_increasing_id())
    parts = F.array_sort(F.collect_list(F.struct("start", "at", "raw")))
    met = pieces.where("piece >= 0").groupBy("source_doc", "nth").agg(F.array_join(F.transform(parts, lambda p: p["raw"]), "\n").alias("raw"))
    rows = pieces.where("piece < 0").select("source_doc", "nth", "raw").union(met)
    # where lines end in two characters, so do breaks in cells, and one stands for both
    plain = F.regexp_replace(F.regexp_replace("raw", "\r$", ""), "\r\n", "\n")
    return rows.withColumn("raw", F.when(F.col("raw").endswith("\r"), plain).otherwise(F.col("raw")))


def csv_rows(spark: SparkSession, path: str | list[str], header: bool = True, multiline: bool = True) -> DataFrame:
    """A file's rows, all text: its columns, source_doc and row_index in file order. Short rows have nulls, cells beyond the header go. Without a
    header columns are col_0, col_1 and so on; a file's own source_doc or row_index is source_doc_ or row_index_. multiline: quoted cells may hold line
    breaks. Large files are split either way, and rows are numbered inside each split, shifted by those of the splits before."""
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    rows = reader.csv(path, header=header, inferSchema=False, multiLine=multiline, escape='"', mode="PERMISSIVE")
    names = [f"{c}_" if c in ("source_doc", "row_index") else c for c in rows.columns] if header else [f"col_{i}" for i in range(len(rows.columns))]
    if multiline:
        quoted = ", ".join(f"c{i} string" for i in range(len(names)))
        found = _raw_rows(spark, path).where(F.col("nth") >= int(header))
        cells = F.from_csv("raw", quoted, {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
        found = found.select(cells.alias("cells"), "source_doc", (F.col("nth") - int(header)).alias("row_index"))
    else:
        rows = rows.toDF(*(f"c{i}" for i in range(len(names))))
        rows = rows.select(F.struct("*").alias("cells"), F.col("_metadata.file_path").alias("source_doc"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        blocks = rows.groupBy(F.col("source_doc").alias("doc"), F.col("block").alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
        blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("doc").orderBy("of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        rows = rows.join(blocks, (F.col("source_doc") == F.col("doc")) & (F.col("block") == F.col("of")))
        found = rows.select("cells", "source_doc", (F.col("at") - F.col("first") + F.col("before")).alias("row_index"))
    return found.select(*[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(names)], "source_doc", "row_index")


def csv_files(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """CSV files as documents: a line "Row n: k: v, k: v" for each row. A document is one cell, so a file must fit in a task."""
    rows = csv_rows(spark, path, header)
    names = [c for c in rows.columns if c not in ("source_doc", "row_index")]
    line = F.concat(F.lit("Row "), (F.col("row_index") + 1).cast("string"), F.lit(": "), F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit("None"))) for c in names]))
    lines = F.array_sort(F.collect_list(F.struct("row_index", line.alias("line"))))
    docs = rows.groupBy("source_doc").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"), F.count("*").alias("row_count"))
    return _shape(docs.withColumnRenamed("source_doc", "source"), "csv")


Loader = Callable[[SparkSession, "str | list[str]"], DataFrame]
_LOADERS: dict[str, Loader] = {".txt": text, ".text": text, ".json": json_files, ".csv": csv_files, ".md": markdown, ".markdown": markdown}


class Ingestion:
    """Loaders by file ending; add_loader() takes any function of (spark, paths) that gives SCHEMA, also one over a Python DataSource."""

    def __init__(self):
        self.loaders = dict(_LOADERS)

    def add_loader(self, ending: str, loader: Loader) -> None:
        self.loaders[ending.lower()] = loader

    @staticmethod
    def ending(path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        ending = self.ending(path)
        if ending not in self.loaders:
            raise ValueError(f"no loader for {ending!r} files")
        return self.loaders[ending](spark, path)

    def load_many(self, spark: SparkSession, paths: Iterable[str]) -> DataFrame:
        """All files that can be read: others, and those of unknown endings, are passed over. One scan for each ending."""
        fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        by: dict[str, list[str]] = {}
        for p in paths:
            path = fs.Path(p)
            if self.ending(p) in self.loaders and path.getFileSystem(conf).exists(path):
                by.setdefault(self.ending(p), []).append(p)
        out = spark.createDataFrame([], SCHEMA)
        for ending, own in by.items():
            out = out.unionByName(self.loaders[ending](spark, own))
        return out

    def load_directory(self, spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
        """Files of known endings in a folder that match the pattern."""
        from fnmatch import fnmatch

        fs = spark._jvm.org.apache.hadoop.fs
        root = fs.Path(folder)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            raise ValueError(f"no such folder: {folder}")
        found, it = [], system.listFiles(root, recursive)
        while it.hasNext():
            p = it.next().getPath()
            if fnmatch(p.getName(), pattern):
                found.append(p.toString())
        return self.load_many(spark, sorted(found))
