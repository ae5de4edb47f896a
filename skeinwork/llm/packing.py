"""Best-fit packing of tokenized documents, improved by a swap-based local search.

Documents become token pieces of at most LIMIT; only the first piece of a cut document is shorter.
What a sequence can hold depends on lengths alone, so the packing is made over the histogram of piece
lengths: at most LIMIT counts, at any size of corpus. Best-fit decreasing puts the counts into
groups of bins with one content; then the search exchanges one-for-one or two-for-one, or moves
pieces, between the emptiest bins and fuller ones, always raising the sum of squared fills, for whole
groups at once, until bins empty. It ends at the least number of bins that the lengths allow, or when
a round over all underfull contents empties none. A piece takes the place that its rank among the
pieces of its length is dealt. Ranks are counted in hash parts, so a length that most pieces have is
split; a row's number in its task is part of the hash, so repeated rows are split too.

Defined cases: a null text is an empty one, and an empty text is one piece that holds the end id;
texts of any length and of any characters are read whole (very long runs of white space by the
tokenizer's own program); rows are packed one by one, repeated rows too; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinwork.llm.common import cut, read, slices

LIMIT = 1024
END = 2
#: Pieces of one length that are ranked at once, about: so many, or a hundred-thousandth of all.
PART_ROWS, PARTS = 500, 100_000


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return out


def encoder(path: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level BPE file in the `tokenizers` format, run by tiktoken, which gives the same ids some seven times
    faster. Process-wide: kept in tiktoken's own registry."""
    kept = tiktoken.registry.ENCODINGS
    if path not in kept:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = _byte_of()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        kept[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return kept[path]


class Tokens:
    """Ids of texts. Texts that tiktoken's pattern engine gives up on (hundreds of thousands of blanks in a row) go to the file's tokenizer."""

    def __init__(self, path: str):
        self.path, self.fast, self.own = path, encoder(path), None

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            self.own = self.own or Tokenizer.from_file(self.path)
            return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, nth (the row's number in its task)."""

    def run(batches):
        tokens, nth = Tokens(path), 0
        for batch in slices(batches, 1):
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(tokens.ids(text or ""), end).astype("<u4")
                first = len(ids) % limit or limit
                for k, start in enumerate([0, *range(first, len(ids), limit)]):
                    part = ids[start : first if k == 0 else start + limit]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), nth))
                nth += 1
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> Bins:
    """Best-fit decreasing over a histogram: contents (lengths, descending) and how many bins have them."""
    by_gap: dict[int, Bins] = defaultdict(dict)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for gap in sorted(g for g in by_gap if g >= length):
            # bins whose gap is just enough first; a bin may take the length more than once
            while left and by_gap[gap]:
                content, n = by_gap[gap].popitem()
                times = min(gap // length, left)
                take = min(n, left // times)
                if take < n:
                    by_gap[gap][content] = n - take
                new = content + (length,) * times
                to = by_gap[gap - times * length]
                to[new] = to.get(new, 0) + take
                left -= take * times
            if not left:
                break
        times = limit // length
        for size, n in ((times, left // times), (left % times, 1)):
            if size and n:
                to = by_gap[limit - size * length]
                to[(length,) * size] = to.get((length,) * size, 0) + n
    return {content: n for group in by_gap.values() for content, n in group.items()}


class Underfull:
    """The underfull contents, with how many bins have them, and what each can give: nothing, one length or two."""

    def __init__(self, bins: Bins):
        self.n = Counter(bins)
        self.given: dict[tuple[int, ...], tuple[list, np.ndarray, np.ndarray]] = {}

    def options(self, content: tuple[int, ...]) -> tuple[list, np.ndarray, np.ndarray]:
        """(lengths given, their sum, their number) of each choice, by distinct lengths."""
        if content not in self.given:
            have = Counter(content)
            one = sorted(have)
            pairs = [(y, x) for i, x in enumerate(one) for y in one[i:] if x < y or have[x] > 1]
            parts = [(), *((x,) for x in one), *pairs]
            self.given[content] = parts, np.array([sum(p) for p in parts]), np.array([len(p) for p in parts])
        return self.given[content]

    def best(self, giver: tuple[int, ...], limit: int):
        """(given, taker, taken back) of the exchange with the giver that raises the sum of squared fills most, or None."""
        takers = [c for c in self.n if c != giver or self.n[c] > 1]
        if not takers:
            return None
        low = sum(giver)
        each = [self.options(c) for c in takers]
        whose = np.repeat(np.arange(len(takers)), [len(p) for p, _, _ in each])
        fill = np.array([sum(c) for c in takers])[whose]
        back, number = np.concatenate([s for _, s, _ in each]), np.concatenate([k for _, _, k in each])
        gap, found = limit - fill, None
        for given, total, many in zip(*(x[1:] for x in self.options(giver))):
            d = total - back
            ok = (d > 0) & (d <= gap) & (fill >= low) & ((number < 2) | (many < 2))
            # filling a bin to the brim comes first
            gain = np.where(ok, 2 * d * (fill - low) + 2 * d * d + np.where(d == gap, limit * limit, 0), 0)
            k = int(gain.argmax())
            if gain[k] > 0 and (found is None or gain[k] > found[0]):
                w = int(whose[k])
                found = gain[k], given, takers[w], each[w][0][k - int(np.searchsorted(whose, w))]
        return found and found[1:]


def search(bins: Bins, limit: int = LIMIT) -> Bins:
    """The local search. The emptiest content gives one or two lengths to another for none, one or two shorter ones that fit its gap (but
    not two for two). What is exchanged goes from the emptier bin to the fuller, so every step raises the sum of squared fills and
    the search ends."""
    full = {c: n for c, n in bins.items() if sum(c) == limit}
    under = Underfull({c: n for c, n in bins.items() if sum(c) < limit})
    least = -(-sum(sum(c) * n for c, n in under.n.items()) // limit)

    def number() -> int:
        return sum(under.n.values()) + sum(full.values())

    least += sum(full.values())
    before = None
    while before != number():
        before, tried = number(), set()
        while number() > least:
            giver = min((c for c in under.n if c not in tried), key=lambda c: (sum(c), c), default=None)
            if giver is None:
                break
            found = under.best(giver, limit)
            if found is None:
                tried.add(giver)
                continue
            given, taker, back = found
            n = under.n[giver] // 2 if taker == giver else min(under.n[giver], under.n[taker])
            a, b = Counter(giver), Counter(taker)
            a.subtract(given)
            a.update(back)
            b.subtract(back)
            b.update(given)
            for c in (giver, taker):
                under.n[c] -= n
                if not under.n[c]:
                    del under.n[c]
            for c in (tuple(sorted(a.elements(), reverse=True)), tuple(sorted(b.elements(), reverse=True))):
                if c and sum(c) == limit:
                    full[c] = full.get(c, 0) + n
                elif c:
                    under.n[c] += n
    return {**full, **under.n}


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end: int = END, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece. path: the tokenizer's file."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, path or public_tokenizers.path("byte_bpe_50k.json"), limit, end), "pack-pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # `limit` rows at most
    bins = search(best_fit(counts, limit), limit)
    base, upto, places = 0, Counter(), []
    for content in sorted(bins, reverse=True):
        n, at = bins[content], 0
        for length in content:
            places.append((length, upto[length], upto[length] + n - 1, base - upto[length], at))
            upto[length] += n
            at += length
        base += n
    # a frequent length has as many parts as it needs, a rare one has one
    part_rows = max(part_rows, sum(counts.values()) // PARTS)
    parts = F.array(*[F.lit(max(1, -(-counts.get(length, 0) // part_rows))).cast("long") for length in range(limit + 1)])
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "doc_id", "piece", "ids_crc32", "nth"), F.get(parts, F.col("length").cast("int"))))
    per = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    per = per.select(F.col("length").alias("length_"), F.col("part").alias("part_"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = rows.withColumn("at", inside).join(per, (F.col("length") == F.col("length_")) & (F.col("part") == F.col("part_")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at"))
    # a row for each length in each different content: some thousands at any size of corpus, as contents come from `limit` lengths
    table = spark.createDataFrame(places, "of long, low long, high long, shift long, offset long")
    fits = (F.col("length") == F.col("of")) & F.col("rank").between(F.col("low"), F.col("high"))
    out = ranked.join(F.broadcast(table), fits)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
