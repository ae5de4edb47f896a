"""Exact top-k search by multi-resolution segment statistics.

Components x become floor(scale * x); the score of two vectors is their integer inner product. A
vector is cut into 1, 4 and 16 segments, and of each the mean and the deviation are kept. Within a
segment of length l, the inner product is at most l * (mean * mean + deviation * deviation)
(Cauchy-Schwarz about the means); in distances, |q - v|^2 is at least the sum of
l * ((mean difference)^2 + (deviation difference)^2). Candidates whose bound, coarse to fine, falls
short of a query's k-th best score so far are out; survivors get the exact score.

Queries are dealt into parts of a bounded number of bytes; each part is broadcast, in blocks past which
the candidates are streamed, so one scan serves a whole part. Each task keeps k per query: what is
shuffled is k rows per query and task.

Defined cases: vectors null, empty, or with null, NaN or infinite components take no part; vectors of
different lengths have no score with each other; equal scores go to the smaller id; rows that share
an id with the query are its own; of several usable vectors under a query's id the least (by
components, first to last) asks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, cut_all, read

SCALE = 256
K = 5
#: Bytes of queries that are broadcast at once, about; queries and candidates that are scored at once.
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 4096
CANDIDATES = 1024
#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)


def segment_stats(x: np.ndarray, parts: int) -> np.ndarray:
    """For each row sqrt(l) * mean and sqrt(l) * deviation of each of `parts` segments: inner products of these rows bound those of x."""
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    spread = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(spread)])


class Search:
    """The best k of each query among the candidates shown so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.stats = [segment_stats(x, n) for n in LEVELS]
        self.score = np.full((len(ids), k), -np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)

    def show(self, ids: np.ndarray, y: np.ndarray) -> None:
        bound_of = self.score[:, -1]
        # a little slack for rounding: bounds are real numbers, scores integers
        rows, cols = None, None
        for q, n in zip(self.stats, LEVELS):
            c = segment_stats(y, n)
            if rows is None:
                bound = q @ c.T
                bound += 1e-9 * np.abs(bound) + 0.01
                rows, cols = np.nonzero(bound >= bound_of[:, None])
            else:
                bound = np.einsum("ij,ij->i", q[rows], c[cols]) if len(rows) < 0.3 * len(q) * len(c) else (q @ c.T)[rows, cols]
                bound += 1e-9 * np.abs(bound) + 0.01
                stay = bound >= bound_of[rows]
                rows, cols = rows[stay], cols[stay]
        own = self.ids[rows] == ids[cols]
        rows, cols = rows[~own], cols[~own]
        if not len(rows):
            return
        dense = len(rows) > 0.3 * len(self.ids) * len(ids)
        scores = (self.x @ y.T)[rows, cols] if dense else np.concatenate([np.einsum("ij,ij->i", self.x[rows[i : i + 65536]], y[cols[i : i + 65536]]) for i in range(0, len(rows), 65536)])
        better = scores >= bound_of[rows]
        rows, cols, scores = rows[better], cols[better], scores[better]
        hit = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(hit, self.k)])
        who = np.concatenate([ids[cols], self.who[hit].ravel()])
        scores = np.concatenate([scores, self.score[hit].ravel()])
        order = np.lexsort((who, -scores, rows))
        rows, who, scores = rows[order], who[order], scores[order]
        first = np.searchsorted(rows, hit)
        at = first[:, None] + np.arange(self.k)
        self.score[hit], self.who[hit] = scores[at], who[at]


def quantized(column: pa.Array, scale: int):
    """(length, positions, integer vectors as doubles) of an Arrow list column's usable vectors, by length."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    # null components become NaN
    x = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    good = (size > 0) & (bad[start + size] == bad[start])
    for n in np.unique(size[good]):
        at = np.flatnonzero(good & (size == n))
        yield int(n), at, x[start[at][:, None] + np.arange(n)]


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], k: int, scale: int):
    """Arrow batches (vec_id, embedding) of candidates to the best k of each query; queries: length, ids, vectors of a block."""

    def run(batches):
        searches: dict[int, list[Search]] = {}
        for n, ids, x in queries.value:
            searches.setdefault(n, []).append(Search(ids, x, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATES):
                rows = batch.slice(lo, CANDIDATES)
                known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = rows.column(0).fill_null(0).to_numpy()
                for n, at, y in quantized(rows.column(1), scale):
                    keep = known[at]
                    for s in searches.get(n, ()):
                        if keep.any():
                            s.show(ids[at[keep]], y[keep])
        for s in (s for own in searches.values() for s in own):
            rows, col = np.nonzero(np.isfinite(s.score))
            yield pa.RecordBatch.from_arrays([pa.array(s.ids[rows]), pa.array(s.who[rows, col]), pa.array(s.score[rows, col])], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_bytes: int = QUERY_BYTES, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query. Both tables: vec_id, embedding."""
    spark = vectors.sparkSession
    vectors = vectors.select(vectors["vec_id"].cast("long"), vectors["embedding"].cast("array<double>"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf"))) & (F.size("embedding") > 0)
    queries = queries.select(queries["vec_id"].cast("long"), queries["embedding"].cast("array<double>")).where(F.col("vec_id").isNotNull() & usable)
    queries = cut(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-queries")
    total = queries.agg(F.sum(8 * F.size("embedding"))).first()[0] or 0
    parts = max(1, -(-total // query_bytes))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best():
        for b in range(parts):
            own = queries.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(parts)) == b).toArrow().combine_chunks()  # about query_bytes
            blocks = []
            if own.num_rows:
                ids = own.column(0).combine_chunks().to_numpy()
                for n, at, x in quantized(own.column(1).combine_chunks(), scale):
                    blocks += [(n, ids[at[i : i + block]], x[i : i + block]) for i in range(0, len(at), block)]
            shared = spark.sparkContext.broadcast(blocks)
            found = vectors.mapInArrow(_search(shared, k, scale), "query_id long, vec_id long, score double")
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            yield found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
            shared.destroy()  # the part is stored by now

    return cut_all(best(), "topk")


def op9_topk(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
