"""Quality rules: hard base rules, then a hashed word and character n-gram logistic regression.

The regression reads word unigrams and bigrams and character (code point) 3- and 5-grams of the
lower-cased text, hashed into one table of weights; its score is the mean weight of a text's n-grams
of each kind. It is trained on labelled quality rows, its scores are calibrated to probabilities
(Platt) on rows kept out of the training, and every whole text is scored in Arrow batches against a
fixed threshold. The sample's n-grams are hashed and counted where the rows are, and stay there: each
pass of the training is a job in which tasks sum the slopes of their own rows, and the driver gets one
sum a task.

Defined cases: a null text is an empty one; a text of fewer than ten words fails the base rules; a
corpus without labels of both kinds keeps what passes the base rules; several labels of one document
count as their least, and of several texts under one id one is learned from (that of the least hash);
repeated rows get the same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read

#: Labelled rows that the regression is trained on, at most: those whose ids hash lowest; and counts of n-grams in them, at most:
#: rows that would go beyond are left out whole.
SAMPLE, COUNTS = 3000, 30_000_000
#: Counts that a task reads at once in training; parts that the sample is dealt to; passes over it and their rate.
STEP, PARTS = 2_000_000, 8
PASSES, RATE = 10, 0.5
#: A document stays if its probability of good quality is at least this.
THRESHOLD = 0.4
BITS = 18
#: Characters of text whose n-grams are held at once, unless one text is longer.
CHUNK = 1 << 20

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()  # on the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: set = set()
        again = {w for w in windows if w in seen or seen.add(w)}
        upto = 0
        for i, w in enumerate(windows):
            if w in again:
                repeated += i + 5 - max(i, upto)
                upto = i + 5
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Grams:
    """Hashed n-grams of texts laid end to end. One instance keeps its powers for many calls."""

    power: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))
    inverse: np.ndarray = field(default_factory=lambda: np.ones(1, np.uint64))

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind of n-gram: buckets of all, and for each text the first and the past-last of its own."""
        lower = [t.lower() for t in texts]
        data = np.frombuffer((" ".join(lower) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.where((data >= 9) & (data <= 13), np.uint32(32), data)
        size = np.array([len(t) for t in lower])
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        end = begin + size
        wide, out = data.astype(np.uint64), []
        for n in (3, 5):
            h = np.zeros(max(0, len(data) - n + 1), np.uint64)
            for k in range(n):
                h = h * np.uint64(_BASE) + wide[k : len(h) + k]
            out.append((_bucket(h, n), np.minimum(begin, len(h)), np.minimum(np.maximum(begin, end - n + 1), len(h))))
        if len(self.power) < len(data) + 1:
            n = 2 * max(len(data), CHUNK)
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
        space = np.concatenate([[True], data == 32])
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * self.power[: len(data)])])
        word = (total[ends] - total[starts]) * self.inverse[starts]
        first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        out.append((_bucket(word, 1), first, last))
        pair = word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:] if len(word) else word
        out.append((_bucket(pair, 2), np.minimum(first, len(pair)), np.maximum(np.minimum(first, len(pair)), last - 1)))
        return out

    def counts(self, texts: list[str | None]):
        """For each text the buckets of its n-grams and their shares in its n-grams of that kind, times SCALE."""
        for _, _, held in chunks(texts):
            kinds = self.of(held)
            for i in range(len(held)):
                cols, vals = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
                for buckets, first, last in kinds:
                    if last[i] > first[i]:
                        c, n = np.unique(buckets[first[i] : last[i]], return_counts=True)
                        cols.append(c)
                        vals.append((n * (SCALE / (last[i] - first[i]))).astype(np.float32))
                yield np.concatenate(cols).astype(np.int32), np.concatenate(vals)


def chunks(texts: list[str | None], size: int = CHUNK):
    """Slices (from, to, the texts) of about `size` characters."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        total += len(held[-1])
        if total >= size:
            yield at, i + 1, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, len(texts), held


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, grams: list) -> np.ndarray:
        out = self.bias
        for buckets, first, last in grams:
            run = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
            out = out + SCALE * (run[last] - run[first]) / np.maximum(1, last - first)
        return out

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))


#: Mean weights are multiplied by this, so that weights stay of the order of one.
SCALE = 20.0


def _rows(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as Grams.counts() gives them, laid end to end: buckets, shares, and how many of them each row has."""
    return np.concatenate([c for c, _ in counts] or [np.zeros(0, np.int32)]), np.concatenate([v for _, v in counts] or [np.zeros(0, np.float32)]), np.array([len(c) for c, _ in counts], np.int64)


@dataclass(frozen=True)
class Local:
    """Rows in one place, for tests and small tables. Every fifth is kept out."""

    rows: tuple[np.ndarray, np.ndarray, np.ndarray]
    y: np.ndarray

    def totals(self) -> np.ndarray:
        held = np.arange(len(self.y)) % 5 == 4
        return np.array([len(self.y), self.y.sum(), (~held).sum(), self.y[~held].sum()], float)

    def slope(self, w: np.ndarray, b: float, every: bool) -> tuple[np.ndarray, float]:
        return _slope(self.rows, self.y, (np.arange(len(self.y)) % 5 == 4) & (not every), w, b)

    def held(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        held = np.arange(len(self.y)) % 5 == 4
        return _logits(self.rows, w, b)[held], self.y[held]


def _logits(rows: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    c, v, n = rows
    return b + np.bincount(np.repeat(np.arange(len(n)), n), w[c] * v, len(n))


def _slope(rows: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """The slopes of the loss over the rows that train, by weight and by the bias, summed."""
    c, v, n = rows
    miss = np.where(held, 0, 1 / (1 + np.exp(-np.clip(_logits(rows, w, b), -40, 40))) - y)
    return np.bincount(c, np.repeat(miss, n) * v, 1 << BITS), float(miss.sum())


@dataclass(frozen=True)
class Stored:
    """Rows (y, held, cols, vals) of a stored table: each pass is a job whose tasks sum the slopes of their own rows. The driver gets one sum a task, of PARTS or so."""

    table: DataFrame

    def totals(self) -> np.ndarray:
        own = F.when(~F.col("held"), 1)
        r = self.table.agg(F.count("*"), F.sum("y"), F.count(own), F.sum(own * F.col("y"))).first()
        return np.array([x or 0 for x in r], float)

    def _each(self, work, names: list[str], schema: str) -> pa.Table:
        """work on (rows, y, held) of about STEP counts at a time; it gives a tuple of columns, or None, and once more with None at the end."""

        def run(batches):
            for batch in batches:
                upto = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
                lo = 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + STEP, "right")))
                    part = batch.slice(lo, hi - lo)
                    rows = tuple(part.column(k).flatten().to_numpy() for k in (2, 3)) + (pc.list_value_length(part.column(2)).to_numpy().astype(np.int64),)
                    out = work(rows, part.column(0).to_numpy().astype(float), part.column(1).to_numpy(zero_copy_only=False))
                    if out is not None:
                        yield pa.RecordBatch.from_arrays(list(out), names=names)
                    lo = hi
            out = work(None, None, None)
            if out is not None:
                yield pa.RecordBatch.from_arrays(list(out), names=names)

        return self.table.select("y", "held", "cols", "vals").mapInArrow(run, schema).toArrow()

    def slope(self, w: np.ndarray, b: float, every: bool) -> tuple[np.ndarray, float]:
        shared = self.table.sparkSession.sparkContext.broadcast(w.astype(np.float32))
        sums: list = []

        def work(rows, y, held):
            if rows is not None:
                slope, miss = _slope(rows, y, held & (not every), shared.value, b)
                sums[:] = [sums[0] + slope, sums[1] + miss] if sums else [slope, miss]
                return None
            return (pa.array([sums[0].astype(np.float32).tobytes()]), pa.array([sums[1]])) if sums else None

        found = self._each(work, ["slope", "miss"], "slope binary, miss double")
        shared.unpersist()
        return sum((np.frombuffer(x, np.float32) for x in found.column(0).to_pylist()), np.zeros(1 << BITS)), sum(found.column(1).to_pylist())

    def held(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        shared = self.table.sparkSession.sparkContext.broadcast(w.astype(np.float32))

        def work(rows, y, held):
            return (pa.array(_logits(rows, shared.value, b)[held]), pa.array(y[held])) if rows is not None else None

        found = self._each(work, ["z", "y"], "z double, y double")
        return found.column(0).to_numpy(), found.column(1).to_numpy()


def train(texts: list[str | None], labels: np.ndarray) -> Model | None:
    """The model of some texts. None without both labels."""
    return learn(Local(_rows(list(Grams().counts(texts))), np.asarray(labels, float)))


def learn(rows: Local | Stored, passes: int = PASSES, rate: float = RATE, decay: float = 1e-6) -> Model | None:
    """AdaGrad over all rows that train, calibration on those that are kept out. None without both labels."""
    n_all, good_all, n, good = rows.totals()
    if n_all < 10 or not 0 < good_all < n_all:
        return None
    # without both labels among the rows that train, all of them train
    every = not 0 < good < n
    n, good = (n_all, good_all) if every else (n, good)
    w, square, b = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), float(np.log(good / (n - good)))
    for _ in range(passes):
        slope, miss = rows.slope(w, b, every)
        b -= rate * miss / n
        slope = slope / n + decay * w
        square += slope * slope
        w -= rate * slope / np.sqrt(square)
    z, y = (np.zeros(0), np.zeros(0)) if every else rows.held(w, b)
    slope, shift = _platt(z, y) if len(y) >= 50 and 0 < y.mean() < 1 else (1.0, 0.0)
    return Model(w.astype(np.float32), b, slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(a z + c))), with Platt's softened targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(c)) if a > 0 else (1.0, 0.0)


def _count(batches):
    grams = Grams()
    for batch in batches:
        found = list(grams.counts(batch.column(2).to_pylist()))
        cols = pa.array([c for c, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "y", "cols", "vals"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, counts: int = COUNTS) -> Model | None:
    """The model of at most `sample` labelled rows with at most `counts` counts of n-grams."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = known.orderBy(order, "doc_id").limit(sample).withColumnRenamed("doc_id", "of")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).groupBy("doc_id").agg(F.first("y").cast("int").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    counted = rows.repartition(PARTS, "doc_id").mapInArrow(_count, "doc_id long, y int, cols array<int>, vals array<float>")
    held = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 4
    table = cut(counted.withColumns({"held": held, "order": order}), "quality-counts")
    sizes = table.select("order", "doc_id", F.size("cols").alias("n")).orderBy("order", "doc_id").collect()  # `sample` rows at most
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), counts, "right"))
    if not fits:
        return None
    last = sizes[fits - 1]
    return learn(Stored(table.where((F.col("order") < last["order"]) | ((F.col("order") == last["order"]) & (F.col("doc_id") <= last["doc_id"])))))


_OUT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("probability", pa.float64()), ("kept", pa.bool_())]


def judge(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, the probability of good quality (null without a model) and kept."""
    def run(batches):
        grams = Grams()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [base_counts(t) for t in texts]
            failed = [base_fails(c[0], c[4]) for c in counts]
            p = None
            if model is not None:
                p = np.concatenate([model.probabilities(model.logits(grams.of(held))) for _, _, held in chunks(texts)] or [np.array([])])
            kept = [not f and (p is None or bool(p[i] >= threshold)) for i, f in enumerate(failed)]
            cols = [*(list(c) for c in zip(*counts)), failed, [None] * len(texts) if p is None else p, kept]
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, _OUT)]], names=["doc_id", *[n for n, _ in _OUT]])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge(docs, fit(docs, read(spark, sf_dir, "labels")))
