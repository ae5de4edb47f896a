"""An approximate index of vectors that is fitted once, stored, added to and read cell by cell: inverted file with product quantisation.

Every vector belongs to the cell of its nearest center. What it is apart from that center is cut into pieces of a few components, and
each piece is named by its nearest codeword, so a code has a byte a piece. A question looks into the cells whose centers are nearest:
their codes are read and compared by tables of distances (question's piece to codeword), the best of them are measured exactly on
their stored vectors, and only those vectors are needed.

The folder holds `model` (centers and codewords, a row each), `codes/cell=...` (vec_id, code) and `vectors/cell=...` (vec_id,
embedding). A search names the cells that its questions look into, so that Spark reads no other folders (partition pruning).

Centers and codewords are fitted on the driver from a bounded sample (`SAMPLE` vectors, those whose ids hash lowest, 40 a cell at
least); every vector is assigned, coded and stored. Null ids, and vectors that are null, empty, not finite or of another dimension
than the sample's, are in no cell, as they have no distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut, cut_all
from skeinwork.operators.vectors import QUERY_BYTES, VECTOR_BLOCK, cell_distances, matrices

#: Vectors that the model is fitted on, at most, with 40 a cell; k-means rounds; codewords of a piece (a code is a byte).
SAMPLE, ROUNDS, WORDS = 20_000, 15, 256
#: Components of a piece, about; the share of cells that a question looks into; candidates that are measured, in multiples of k.
PIECE, PROBED, MEASURED = 4, 0.6, 8
#: Distances that are worked out at once.
PAIRS = 1 << 20


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([cell_distances(x[i : i + VECTOR_BLOCK], c).argmin(1) for i in range(0, len(x), VECTOR_BLOCK)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Model:
    """centers: a row for each cell; words: for each piece its codewords (fewer than WORDS if the sample has fewer rows). Pieces are runs of components."""

    centers: np.ndarray
    words: tuple[np.ndarray, ...]

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum([w.shape[1] for w in self.words])

    def pieces(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.ends[:-1], axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of vectors."""
        cell = _nearest(x, self.centers)
        return cell, np.stack([_nearest(p, w) for p, w in zip(self.pieces(x - self.centers[cell]), self.words)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """For each question, piece and codeword the squared distance of the question's piece in this cell from the codeword."""
        out = np.full((len(q), len(self.words), WORDS), np.inf)
        for j, (p, w) in enumerate(zip(self.pieces(q - self.centers[cell]), self.words)):
            out[:, j, : len(w)] = (p * p).sum(1)[:, None] + cell_distances(p, w)
        return out

    def rows(self) -> list[tuple]:
        cells = [("center", k, 0, c.tolist()) for k, c in enumerate(self.centers)]
        return cells + [("word", j, i, w.tolist()) for j, ws in enumerate(self.words) for i, w in enumerate(ws)]


_MODEL = "kind string, a int, b int, x array<double>"


def fit(vectors: DataFrame, cells: int | None = None, piece: int = PIECE, seed: int = 7) -> Model:
    """cells: the square root of the number of vectors, from 16 to 4096, if not given. A model without cells if there are no usable vectors."""
    if cells is None:
        cells = int(min(4096, max(16, round(vectors.count() ** 0.5))))
    some = vectors.where("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 40 * cells)).select(F.col("embedding").cast("array<double>")).toArrow()
    known = max(matrices(some.column(0).combine_chunks()), key=lambda m: len(m[1]), default=None) if some.num_rows else None
    if known is None:
        return Model(np.zeros((0, 0)), ())
    x, rng = known[2], np.random.default_rng(seed)
    centers = _kmeans(x, cells, rng)
    apart = x - centers[_nearest(x, centers)]
    return Model(centers, tuple(_kmeans(p, WORDS, rng) for p in np.array_split(apart, max(1, -(-x.shape[1] // piece)), axis=1)))


def load(spark: SparkSession, folder: str) -> Model:
    """The stored model: a row for each center and codeword, of which there is a bounded number."""
    rows = spark.read.schema(_MODEL).parquet(f"{folder}/model").orderBy("kind", "a", "b").collect()
    words: dict[int, list] = {}
    for r in rows:
        if r["kind"] == "word":
            words.setdefault(r["a"], []).append(r["x"])
    centers = [r["x"] for r in rows if r["kind"] == "center"]
    return Model(np.array(centers) if centers else np.zeros((0, 0)), tuple(np.array(w) for _, w in sorted(words.items())))


def _coded(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, embedding, code and cell of every usable vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for n, at, x in matrices(batch.column(1)):
                if not len(own.centers) or n != own.centers.shape[1]:
                    continue
                at, x = at[known[at]], x[known[at]]
                cell, code = own.encode(x)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell, pa.int32())], names=["vec_id", "embedding", "code", "cell"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, embedding array<double>, code binary, cell int")


def _append(vectors: DataFrame, model: Model, folder: str) -> None:
    # cells of like size to a task each, large ones to several
    rows = cut(_coded(vectors, model), "ivf-coded")
    for name in ("code", "embedding"):
        rows.select("vec_id", name, "cell").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{folder}/{'codes' if name == 'code' else 'vectors'}")


def build(vectors: DataFrame, folder: str, cells: int | None = None, piece: int = PIECE) -> None:
    """Fits a model, and stores it with all vectors (vec_id, embedding) in a folder that is new."""
    model = fit(vectors, cells, piece)
    vectors.sparkSession.createDataFrame(model.rows(), _MODEL).coalesce(1).write.parquet(f"{folder}/model")
    _append(vectors, model, folder)


def add(vectors: DataFrame, folder: str) -> None:
    """Stores further vectors under the model as it is. Ids that the index has already stay as they are, so adding again changes nothing."""
    spark = vectors.sparkSession
    there = _table(spark, folder, "codes").select(F.col("vec_id").alias("id"))
    fresh = vectors.withColumn("vec_id", F.col("vec_id").cast("long")).dropDuplicates(["vec_id"])
    _append(fresh.join(there, fresh["vec_id"] == there["id"], "left_anti"), load(spark, folder), folder)


def _table(spark: SparkSession, folder: str, name: str, cells: list[int] | None = None) -> DataFrame:
    """A table of the index; with cells, of those alone."""
    what = "code binary" if name == "codes" else "embedding array<double>"
    found = spark.read.schema(f"vec_id long, {what}, cell int").parquet(f"{folder}/{name}")
    return found if cells is None else found.where(F.col("cell").isin(cells))


class Kept:
    """The k best (distance, id, cell) of each question, of what was shown so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d, self.who, self.cell = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def show(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, cell: int) -> None:
        """d: for questions `rows` (a row each) and vectors `ids`."""
        d = np.concatenate([self.d[rows], d], axis=1)
        who = np.concatenate([self.who[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        where = np.concatenate([self.cell[rows], np.full((len(rows), len(ids)), cell)], axis=1)
        best = np.lexsort((who, d), axis=1)[:, : self.k]
        self.d[rows], self.who[rows], self.cell[rows] = (np.take_along_axis(x, best, axis=1) for x in (d, who, where))


def _scanned(table: DataFrame, ids: pa.Array, q: np.ndarray, looks: np.ndarray, model: Model, k: int, exact: bool, kind: str) -> DataFrame:
    """query_id, vec_id, cell, distance: the k best of each question in the cells that it looks into, by codes or exactly, over all tasks."""
    shared = table.sparkSession.sparkContext.broadcast((ids, q, looks, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x, sees, m = shared.value
        kept = Kept(len(x), k)
        for batch in batches:
            at_cell, vid = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            order = np.argsort(at_cell, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at_cell[order])) + 1):
                if not len(part):
                    continue
                cell = int(at_cell[part[0]])
                rows = np.flatnonzero(sees[:, cell])
                step = max(1, PAIRS // len(part))
                y = np.array(batch.column(1).take(pa.array(part)).to_pylist()) if exact else np.frombuffer(b"".join(batch.column(1).take(pa.array(part)).to_pylist()), np.uint8).reshape(len(part), -1)
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    if exact:
                        d = np.stack([((y - z) ** 2).sum(1) for z in x[some]])
                    else:
                        tables, d = m.tables(x[some], cell), np.zeros((len(some), len(part)))
                        for j in range(y.shape[1]):
                            d += tables[:, j, y[:, j]]
                    kept.show(some, d, vid[part], cell)
        r, c = np.nonzero(np.isfinite(kept.d))
        yield pa.RecordBatch.from_arrays([own.take(pa.array(r)), pa.array(kept.who[r, c]), pa.array(kept.cell[r, c].astype(np.int32)), pa.array(kept.d[r, c])], names=["query_id", "vec_id", "cell", "distance"])

    what = "embedding" if exact else "code"
    found = table.select("vec_id", what, "cell").mapInArrow(run, f"query_id {kind}, vec_id long, cell int, distance double")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int, probed: float = PROBED, measured: int | None = MEASURED, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, distance (squared): each question's k nearest among the vectors of the cells that it looks into. queries: query_id, query.

    measured: so many times k candidates are chosen by codes and then measured; None measures all vectors of those cells, without codes: with all
    cells probed that is the exact answer. Questions come to the driver in parts of a bounded number of bytes, each with the list of its cells.
    """
    model = load(spark, folder)
    kind = dict(queries.dtypes)["query_id"]
    asked = cut(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), "ivf-asked")
    total = asked.agg(F.sum(8 * (F.size("query") + len(model.centers)))).first()[0] or 0
    parts = max(1, -(-total // query_bytes))
    probes = int(np.ceil(probed * len(model.centers)))
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id long, distance double")

    def one(part: int) -> DataFrame:
        own = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow().combine_chunks()
        for n, at, x in matrices(own.column(1).combine_chunks()) if own.num_rows else []:
            if not len(model.centers) or n != model.centers.shape[1]:
                continue
            looks = np.zeros((len(x), len(model.centers)), bool)
            np.put_along_axis(looks, np.argsort(cell_distances(x, model.centers), axis=1, kind="stable")[:, :probes], True, axis=1)
            cells = np.flatnonzero(looks.any(0)).tolist()
            ids = own.column(0).combine_chunks().take(pa.array(at))
            if measured is None:
                return _scanned(_table(spark, folder, "vectors", cells), ids, x, looks, model, k, True, kind).select("query_id", "rank", "vec_id", "distance")
            chosen = cut(_scanned(_table(spark, folder, "codes", cells), ids, x, looks, model, measured * k, False, kind).select("query_id", "vec_id", "cell"), "ivf-candidates")
            return _measured(chosen, _table(spark, folder, "vectors", cells), asked, k)
        return empty

    return one(0) if parts == 1 else cut_all((one(p) for p in range(parts)), "ivf-found")


def _measured(chosen: DataFrame, stored: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of the chosen (query_id, vec_id, cell) by their stored vectors. Spark broadcasts the chosen if they are few, else both are shuffled."""
    met = stored.join(chosen, ["cell", "vec_id"]).join(asked, "query_id")
    square = F.aggregate(F.zip_with("embedding", "query", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, d: acc + d)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "vec_id"))
    near = met.select("query_id", "vec_id", square.alias("distance")).withColumn("rank", nth)
    return near.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
