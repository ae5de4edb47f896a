"""Vector search by squared distance, least first. Tables of vectors are streamed against blocks of questions, never the reverse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut, cut_all

#: Bytes of questions that are broadcast at once, about; questions and vectors that are compared at once; pairs that are measured at once.
QUERY_BYTES, QUERY_BLOCK, VECTOR_BLOCK, PAIRS = 32 << 20, 1024, 2048, 1 << 16


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, positions, vectors) of an Arrow list column, by dimension; null, empty and non-finite vectors are passed over."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (size > 0) & (bad[start + size] == bad[start])
    for n in np.unique(size[good]):
        at = np.flatnonzero(good & (size == n))
        yield int(n), at, x[start[at][:, None] + np.arange(n)]


class Nearest:
    """The k nearest of a block of questions among the vectors shown so far: (distance, id), least first."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.k = x, k
        self.square = (x * x).sum(1)
        self.distance = np.full((len(x), k), np.inf)
        self.who = np.full((len(x), k), np.iinfo(np.int64).max)

    def show(self, ids: np.ndarray, y: np.ndarray) -> None:
        if not len(ids):
            return
        near = self.square[:, None] + (y * y).sum(1)[None] - 2 * self.x @ y.T
        # the matrix product rounds: what may be among the k nearest is measured
        slack = 1e-9 * (self.square[:, None] + near.max(initial=0)) + 1e-12
        bound = np.minimum(np.partition(near, self.k - 1, axis=1)[:, [self.k - 1]] if near.shape[1] > self.k else np.inf, self.distance[:, -1:])
        r, c = np.nonzero(near <= bound + slack)
        d = np.concatenate([((self.x[r[i : i + PAIRS]] - y[c[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(r), PAIRS)] or [np.zeros(0)])
        hit = np.unique(r)
        if not len(hit):
            return
        r = np.concatenate([r, np.repeat(hit, self.k)])
        d, who = np.concatenate([d, self.distance[hit].ravel()]), np.concatenate([ids[c], self.who[hit].ravel()])
        order = np.lexsort((who, d, r))
        at = np.searchsorted(r[order], hit)[:, None] + np.arange(self.k)
        self.distance[hit], self.who[hit] = d[order][at], who[order][at]


def _scan(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int) -> DataFrame:
    """query_id, rank, vec_id, distance. Parts of the questions of a bounded number of bytes are broadcast; each task keeps k a question,
    and only those are shuffled."""
    spark = vectors.sparkSession
    kind = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    total = asked.agg(F.sum(8 * F.size("query"))).first()[0] or 0
    parts = max(1, -(-total // query_bytes))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))

    def one(part: int) -> DataFrame:
        own = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow().combine_chunks()
        blocks = []
        if own.num_rows:
            ids = own.column(0).combine_chunks()
            for n, at, x in matrices(own.column(1).combine_chunks()):
                for i in range(0, len(at), QUERY_BLOCK):
                    blocks.append((n, ids.take(pa.array(at[i : i + QUERY_BLOCK])), x[i : i + QUERY_BLOCK]))
        shared = spark.sparkContext.broadcast(blocks)

        def run(batches):
            searches = [(n, ids, Nearest(x, k)) for n, ids, x in shared.value]
            for batch in batches:
                for lo in range(0, batch.num_rows, VECTOR_BLOCK):
                    rows = batch.slice(lo, VECTOR_BLOCK)
                    known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
                    vid = rows.column(0).fill_null(0).to_numpy()
                    for n, at, y in matrices(rows.column(1)):
                        at, y = at[known[at]], y[known[at]]
                        for dim, _, search in searches:
                            if dim == n:
                                search.show(vid[at], y)
            for _, ids, search in searches:
                r, c = np.nonzero(np.isfinite(search.distance))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), pa.array(search.who[r, c]), pa.array(search.distance[r, c])], names=["query_id", "vec_id", "distance"])

        found = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, f"query_id {kind}, vec_id long, distance double")
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")

    return one(0) if parts == 1 else cut_all((one(p) for p in range(parts)), "nearest")


def _named(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The hits with what else is known of vectors and questions. No embedding is joined."""
    meta, asked = vectors.drop("embedding"), queries.drop("query")
    return found.join(meta.withColumn("vec_id", F.col("vec_id").cast("long")), "vec_id").join(asked, "query_id")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, distance and the other columns: each query's k nearest vectors, ties to the smaller id. Vectors and queries
    that are null, empty, not finite or of another dimension have no distance."""
    return _named(_scan(vectors, queries, k, query_bytes), vectors, queries)


def search(vectors: DataFrame, queries: DataFrame, k: int, condition: Column | None = None, prefilter: bool = False) -> DataFrame:
    """Top k under a condition. As specified, 2k are found, then filtered, then cut to k, so fewer may come; prefilter looks among the vectors that fit."""
    if condition is None:
        return top_k(vectors, queries, k)
    if prefilter:
        return top_k(vectors.where(condition), queries, k)
    kept = top_k(vectors, queries, 2 * k).where(condition)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def similarity(d: Column) -> Column:
    return 1 / (1 + d)


def above_threshold(hits: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Hits by similarity 1 / (1 + distance), those of `threshold` and more."""
    return hits.withColumn("similarity", similarity(F.col("distance"))).where(F.col("similarity") >= threshold)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with row numbers from 0 in the given order, without taking all rows through one task: ranges are sorted and counted side by
    side, and each is shifted by the counts of those before."""
    dealt = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    dealt = cut(dealt, "numbered").withColumns({"__part": F.shiftright("__m", 33), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # a row for each range
    return dealt.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__m", "__part", "__at", "__before")


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """new behind what the store holds, with the next ids in order of `ord`. Vectors must have the store's dimension: others raise."""
    start = store.agg((F.coalesce(F.max("vec_id"), F.lit(-1)) + 1).alias("start"), F.first(F.size("embedding")).alias("dim"))
    ok = numbered(new, "ord", "vec_id").join(F.broadcast(start))  # one row
    checked = F.when(F.col("dim").isNull() | (F.size("embedding") == F.col("dim")), F.col("embedding")).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("array<float>"))
    ok = ok.withColumns({"embedding": checked, "vec_id": (F.col("vec_id") + F.col("start")).cast("long")})
    return store.unionByName(ok.select(*[c for c in store.columns if c in ok.columns]), allowMissingColumns=True)


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the store that new doesn't name, and new."""
    return store.join(new.select(key), key, "left_anti").unionByName(new)


def delete(store: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def lookup(store: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        store = store.where(F.col(name) == value)
    return store


def statistics(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"), F.lit("flat").alias("index_type"))


def cell_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to the centers, less each row's own square."""
    return (centers * centers).sum(1)[None] - 2 * x @ centers.T
