"""Mixing sources to target weights by cube-method balanced sampling.

A source that is to give r times its words gives every document floor(r) times, and once more to a
balanced sample with inclusion probability r - floor(r). The cube method draws that sample: it moves
the vector of probabilities through the null space of the constraints (words, documents) until a
coordinate is 0 or 1, three open documents at a time, so that both totals stay as they are. Two
documents at most are open at the end of a block; those of all blocks of a source meet in the next
round, and the last two of a source are the landing problem.

Defined cases: a null or empty text has 0 words and its row stays, with 0 taken; a null source is a
source of its own, last in order; a null id is an id like any other; other columns go along, whatever their
names and kinds. m equal rows (in all columns, maps and variants too; 64 bits of hash stand for them) are one unit: of its m * p further copies the whole ones are sure and the
sample draws for one row alone, so a group of copies lands as near as a single document. An empty
table gives an empty result. The sources are ordered and summed in one task: a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, n_words, packed, read, row_hash

#: Units that one task holds at once in a flight.
BLOCK = 4096
#: Probabilities nearer than this to 0 or 1 are 0 or 1.
EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, n_units, target: shares of share * all words by weight, none above cap * its source's words.

    A source is at its cap when cap * words / weight is at most the level that the others share; in
    the order of that ratio the level is a quotient of running sums, so one pass finds it.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n_units"))
    kth = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), kth))
    per = per.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
    everything = W.partitionBy()
    upto = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("source_size").over(everything)
    capped = F.lit(cap) * (F.sum("source_size").over(upto) - F.col("source_size"))
    weight_left = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    per = per.withColumn("level", (F.lit(share) * total - capped) / weight_left)
    target = F.least(F.lit(cap) * F.col("source_size"), F.max("level").over(everything) * F.col("weight"))
    return per.select("source", "source_size", "n_units", target.alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: p with at most two entries left strictly between 0 and 1, sum(p) and sum(p * x) as before."""
    p = p.astype(float).tolist()
    x = (x / max(1.0, float(np.max(x, initial=1)))).tolist()
    draws = iter(())
    hold: list[int] = []
    for k in range(len(p)):
        if not EPS < p[k] < 1 - EPS:
            continue
        hold.append(k)
        if len(hold) < 3:
            continue
        i, j, m = hold
        # the null space of the two constraint rows (1, 1, 1) and (x_i, x_j, x_m) is their cross product
        v = (x[m] - x[j], x[i] - x[m], x[j] - x[i])
        if max(map(abs, v)) < 1e-12:
            v = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / d if d > 0 else p[a] / -d for a, d in zip(hold, v) if d)
        down = min(p[a] / d if d > 0 else (1 - p[a]) / -d for a, d in zip(hold, v) if d)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(1024).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        for a, d in zip(hold, v):
            p[a] = min(1.0, max(0.0, p[a] + step * d))
        hold = [a for a in hold if EPS < p[a] < 1 - EPS]
    out = np.array(p)
    out[out <= EPS] = 0
    out[out >= 1 - EPS] = 1
    return out


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rounding of the (at most two) open entries that changes sum(p * x) least; ties: fewer documents."""
    left = np.flatnonzero((p > 0) & (p < 1))
    best = min((abs(sum(((c >> k & 1) - p[i]) * x[i] for k, i in enumerate(left))), bin(c).count("1"), c) for c in range(1 << len(left)))[2]
    p = p.copy()
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    return p


_STATE = ["doc_id", "source", "size", "row_hash", "m", "source_size", "target", "base", "sure", "p"]
_STATE_SCHEMA = "doc_id long, source string, size long, row_hash long, m long, source_size long, target double, base long, sure long, p double"


def _fly(table: pa.Table) -> pa.Table:
    """One block through the flight, the last block of a source through the landing too. Ids stay Arrow integers: nulls don't make them floats."""
    ids = table.column("doc_id")
    size = table.column("size").to_numpy()
    rows = np.lexsort((table.column("m").to_numpy(), table.column("row_hash").to_numpy(), size, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy()))
    table = table.take(pa.array(rows))
    first = [table.column(c)[0].as_py() for c in ("source", "block", "round", "blocks")]
    rng = np.random.default_rng(zlib.crc32(repr((*first[:3], len(rows))).encode("utf-8", "surrogatepass")))
    order = rng.permutation(len(rows))
    x = size[rows].astype(float)
    p = table.column("p").to_numpy().copy()
    p[order] = flight(p[order], x[order], rng)
    if first[3] == 1:
        p = landing(p, x)
    return table.select(_STATE[:-1]).append_column("p", pa.array(p))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, row_hash, m, source_size, target, base, extra: the mix takes each of m equal rows base times, and extra of them once more.

    Only ids and counts are shuffled. Blocks are hash parts of a source, so a source that holds a third of all rows has a third of
    all blocks. A round leaves two open units a block, so their number falls to a fraction and rounds end when none is open.
    """
    if block < 4:
        raise ValueError("a block of fewer than 4 units may not get smaller")
    units = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), row_hash(docs).alias("row_hash"))
    units = cut(units.groupBy("doc_id", "source", "size", "row_hash").agg(F.count("*").alias("m")), "mix-units")
    per = targets(units, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate + F.lit(EPS))
    each = (rate - base) * F.col("m")
    sure = F.when(rate - base > EPS, F.floor(each + F.lit(EPS))).otherwise(0)
    names = ["doc_id", "source", "size", "row_hash", "m", "source_size", "target"]
    state = units.join(per.withColumnRenamed("source", "of"), units["source"].eqNullSafe(F.col("of")))
    state = state.select(*names, base.cast("long").alias("base"), sure.cast("long").alias("sure"), F.greatest(F.lit(0.0), each - sure).alias("p"), "n_units")
    state = state.withColumn("p", F.when(F.col("p") > EPS, F.col("p")).otherwise(0.0))
    done, k = None, 0
    while True:
        blocks = F.ceil(F.col("n_units") / F.lit(block)).cast("long")
        state = state.withColumns({"blocks": blocks, "round": F.lit(k)})
        state = state.withColumn("block", F.pmod(F.xxhash64(F.lit(k), "doc_id", "size", "row_hash"), F.col("blocks")))
        flown = cut(state.groupBy("source", "block").applyInArrow(_fly, _STATE_SCHEMA), f"mix-{k}")
        settled = flown.where((F.col("p") == 0) | (F.col("p") == 1))
        done = settled if done is None else done.union(settled)
        state = flown.where((F.col("p") > 0) & (F.col("p") < 1))
        if state.isEmpty():
            return done.select(*names, "base", (F.col("sure") + F.col("p").cast("long")).alias("extra"))
        counts = state.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("n_units"))
        state = state.join(counts, state["source"].eqNullSafe(F.col("of"))).select(*_STATE, "n_units")
        k += 1


def repeat(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: docs, each row as often as the mix takes it. Equal rows travel as one (a group of copies is combined before it is
    shuffled) and come out as often as all of them are taken; rows that the mix doesn't take go. Nulls are values like any other."""
    mixed = mix(docs, weights, share, cap)
    total = F.col("m") * F.col("base") + F.col("extra")
    # the hash tells a null id from 0
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    mixed = mixed.select(known.alias("id"), F.col("row_hash").alias("of"), total.alias("copies")).where("copies > 0")
    rows = packed(docs, doc=known, hash=row_hash(docs)).dropDuplicates(["doc", "hash"])
    rows = rows.join(mixed, (rows["doc"] == mixed["id"]) & (rows["hash"] == mixed["of"]))
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    taken = F.col("size") * (F.col("base") + (F.col("row") <= F.col("extra")).cast("long"))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")
