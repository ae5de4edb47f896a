"""A text model learned from a corpus: words that stand in like company get like vectors, texts get the weighted mean of their words'.

Pairs of words that stand within WINDOW words of each other are counted over all documents, the counts become positive pointwise mutual
information, and a randomised singular value decomposition gives each word a vector. Counting is explode, group and sum in the JVM,
combined before the shuffle; the decomposition is a few passes over the stored pairs, in which tasks multiply their entries with a
matrix of vocabulary by dimension and their products are summed by word.

The vocabulary is bounded (VOCABULARY: the words that most documents have, ties to the lesser word), so the matrices that are
broadcast and come to the driver are, too: VOCABULARY * (dimension + OVER) doubles. All documents are counted, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut
from skeinwork.functions.text import find_all

#: Words that have vectors, at most; documents that a word needs; words on either side that count as company.
VOCABULARY, LEAST, WINDOW = 20_000, 2, 4
#: Dimensions beyond those asked for, and passes, of the randomised decomposition. Frequent words weigh RARE / (RARE + share) in a text.
OVER, PASSES, RARE = 10, 3, 1e-3
#: Words of a text whose pairs are made at once: windows across its parts are kept.
PART = 512


def words(text: Column) -> Column:
    return find_all(F.lower(text), r"(?U)\w+")


@dataclass(frozen=True)
class TextModel:
    """A client for Embedder: a list of texts to unit rows. Texts without known words are rows of zeros."""

    index: dict[str, int]
    vectors: np.ndarray
    weights: np.ndarray

    @property
    def dimension(self) -> int:
        return self.vectors.shape[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            known = [self.index[w] for w in re.findall(r"\w+", (text or "").lower()) if w in self.index]
            if known:
                at, n = np.unique(known, return_counts=True)
                out[i] = (n * self.weights[at]) @ self.vectors[at]
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vocabulary(docs: DataFrame, size: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """word, id (from 0, most documents first), n (how often it is there): `size` rows at most."""
    per = docs.select(F.explode(words(F.col("text"))).alias("word"), F.monotonically_increasing_id().alias("doc")).groupBy("word", "doc").agg(F.count("*").alias("n"))
    known = per.groupBy("word").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    best = cut(known.orderBy(F.col("docs").desc(), "word").limit(size), "model-words")
    return best.select("word", (F.row_number().over(W.orderBy(F.col("docs").desc(), "word")) - 1).alias("id"), "n")  # `size` rows


def pairs(docs: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b, n: how often words a and b (a < b, by id) stand within `window` words of each other, over all documents. Other words keep their places.

    A text is cut into parts of PART words, each with the `window` words that follow, so a long text is many rows; a word is looked up once for
    each part that it is in."""
    parts = docs.select(words(F.col("text")).alias("w")).where(F.size("w") > 1)
    start = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PART)))
    parts = parts.select("w", start.alias("lo")).select(F.monotonically_increasing_id().alias("part"), F.slice("w", F.col("lo") + 1, F.lit(PART + window)).alias("w"))
    placed = parts.select("part", F.posexplode("w").alias("at", "word")).join(known.select("word", "id"), "word")
    # a part's own words each meet those up to `window` behind them; the first of a pair is in the part, so no pair is counted twice
    along = W.partitionBy("part").orderBy("at")
    behind = F.array(*[F.lead(F.struct("at", "id"), j).over(along) for j in range(1, window + 1)])
    met = placed.select("at", "id", behind.alias("behind")).where(F.col("at") < PART).select("at", "id", F.explode("behind").alias("q"))
    met = met.where((F.col("q.at") <= F.col("at") + window) & (F.col("q.id") != F.col("id")))
    return met.groupBy(F.least("id", "q.id").alias("a"), F.greatest("id", "q.id").alias("b")).agg(F.count("*").alias("n"))


def ppmi(counted: DataFrame) -> DataFrame:
    """a, b, x: positive pointwise mutual information of pairs, from both sides."""
    both = counted.union(counted.select("b", "a", "n"))
    margin = cut(both.groupBy("a").agg(F.sum("n").alias("m")), "model-margins")  # a row a word
    total = margin.agg(F.sum("m")).first()[0] or 1
    left, right = margin.withColumnsRenamed({"a": "la", "m": "lm"}), margin.withColumnsRenamed({"a": "ra", "m": "rm"})
    x = F.ln(F.col("n") * F.lit(float(total)) / (F.col("lm") * F.col("rm").cast("double")))
    met = both.join(left, both["a"] == left["la"]).join(right, both["b"] == right["ra"])
    return met.select("a", "b", x.alias("x")).where("x > 0")


def _times(entries: DataFrame, y: np.ndarray) -> np.ndarray:
    """The product of the matrix of entries (a, b, x) with y: tasks multiply, sums by word are combined in the JVM."""
    shared = entries.sparkSession.sparkContext.broadcast(y)
    width = y.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x = (batch.column(k).to_numpy() for k in range(3))
            order = np.argsort(a, kind="stable")
            a, first = np.unique(a[order], return_index=True)
            rows = np.add.reduceat(shared.value[b[order]] * x[order, None], first, axis=0) if len(a) else np.zeros((0, width))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), width).cast(pa.list_(pa.float64()))], names=["a", "row"])

    found = entries.mapInArrow(run, "a int, row array<double>")
    summed = found.groupBy("a").agg(*[F.sum(F.get("row", F.lit(k))).alias(f"s{k}") for k in range(width)]).toArrow()
    out = np.zeros_like(y)
    if summed.num_rows:
        out[summed.column(0).to_numpy()] = np.stack([summed.column(k + 1).to_numpy() for k in range(width)], axis=1)
    shared.unpersist()
    return out


def fit(docs: DataFrame, dimension: int = 64, size: int = VOCABULARY, least: int = LEAST, window: int = WINDOW, seed: int = 3) -> TextModel:
    """The model of a corpus (text; null and empty texts have no words). Texts without two known words near each other give a model without vectors."""
    known = vocabulary(docs, size, least)
    table = cut(known, "model-vocabulary")
    rows = table.orderBy("id").toArrow()
    names, n = rows.column(0).to_pylist(), rows.column(2).to_numpy().astype(float)
    share = n / max(1.0, n.sum())
    weights = RARE / (RARE + share)
    entries = cut(ppmi(cut(pairs(docs, table, window), "model-pairs")), "model-entries")
    # the range of the matrix by a few products with a random one, then the small decomposition of what it is there
    width = min(dimension + OVER, len(names))
    y = np.random.default_rng(seed).standard_normal((len(names), width))
    for _ in range(PASSES):
        y = np.linalg.qr(_times(entries, y))[0] if len(names) else y
    small = y.T @ _times(entries, y) if len(names) else np.zeros((0, 0))
    value, vector = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-np.abs(value))[:dimension]
    vectors = y @ vector[:, best] * np.sqrt(np.abs(value[best]))
    # a vector's sign is free: the largest component is positive
    top = np.abs(vectors).argmax(0) if len(names) else []
    vectors = vectors * np.sign(vectors[top, np.arange(len(best))]) if len(names) else np.zeros((0, dimension))
    return TextModel({w: i for i, w in enumerate(names)}, np.pad(vectors, ((0, 0), (0, dimension - vectors.shape[1]))), weights)
