"""What the operators share: reading tables, words, equality with nulls."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions.storage import cut, cut_all, scope, shared_dir

__all__ = ["WORD", "cut", "cut_all", "n_words", "packed", "read", "row_hash", "same", "scope", "shared_dir", "slices"]

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at once, unless one text is longer.
SLICE = 1 << 20


def give_back() -> None:
    """Freed memory of a worker goes back to the system: workers live on between tasks, and several share a machine with their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it gives back what it does
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about `size` bytes in a column of texts, so that what is made of them stays small, however long they are. After
    each batch what it took is given back."""
    for batch in batches:
        total = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(total.searchsorted((total[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch
        give_back()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns, null equal to null."""
    out = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        out = out & left[name].eqNullSafe(right[name])
    return out


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """row, a struct of all columns of docs, and the columns that are worked with beside it: no name of docs can clash with theirs.
    select("row.*") gives docs' columns back."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in more.items()])


def _told(value: Column, kind: T.DataType) -> Column:
    """A value for a hash, nulls told from what isn't there: whether it is null, and itself."""
    return F.struct(value.isNull().alias("none"), _plain(value, kind).alias("value"))


def _plain(value: Column, kind: T.DataType) -> Column:
    """A value for a hash: lists and structs with their nulls marked, maps as their entries in order, variants as JSON."""
    if isinstance(kind, T.ArrayType):
        return F.struct(F.size(value).alias("n"), F.transform(value, lambda x: _told(x, kind.elementType)).alias("x"))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(_told(e["key"], kind.keyType).alias("key"), _told(e["value"], kind.valueType).alias("value"))
        return F.struct(F.size(value).alias("n"), F.array_sort(F.transform(F.map_entries(value), entry)).alias("x"))
    if isinstance(kind, T.StructType):
        return F.struct(*[_told(value.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields)])
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value


def row_hash(docs: DataFrame) -> Column:
    """64 bits that stand for a row's columns, whatever their kinds: rows are equal if all of them are, maps in any order of their entries."""
    columns = [docs[f"`{f.name.replace('`', '``')}`"] for f in docs.schema.fields]
    return F.xxhash64(*[_plain(c, f.dataType) for c, f in zip(columns, docs.schema.fields)], *[c.isNull() for c in columns])
