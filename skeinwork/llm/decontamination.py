"""Benchmark decontamination by winnowing: which words of documents stand in a passage that a benchmark item has too.

A passage is WINDOW consecutive words of an item. Of the GRAM-word sequences in it the least hash is its
fingerprint, so a passage that both sides have gives both the same fingerprint; neighbouring windows share
theirs, so a document has about two for every seven words.

1. Select: a document's runs of windows with one fingerprint, where the bits of a filter made of the
   benchmark's fingerprints allow it. The filter has a bounded size (FILTER_BITS); what it lets through
   beyond the benchmark's own fingerprints costs rows, and never a result.
2. Join: those runs meet the benchmark's fingerprints.
3. Extend: a run's words are read as windows on both sides of the fingerprint, and those that equal one
   of the benchmark's, word by word, are hits. Hits that overlap or touch become one span.

Items of fewer than WINDOW words are below what winnowing is sure to find: each is one window whose
hash is looked for at every word, for each of their (at most nine) lengths, through the same filter and joins.

Words are hashed in numpy over a batch's bytes; fingerprints, words and spans are shuffled, never texts.

Defined cases: null and empty texts, and those without words, have no words, no hits and no spans; a
null id is an id like any other; rows equal in id and text have the same result, one row each; items of
one id are one item, a null id is the item `null`; an empty benchmark hits nothing, an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read, same, slices

#: Words of a passage that is sure to be found; words of a sequence whose hash may be its fingerprint.
WINDOW, GRAM = 10, 5
#: Bits of the filter for a fingerprint, about; the least and the most bits of a filter (powers of two; 16 MB at most).
BITS_EACH, FILTER_BITS = 64, (16, 27)
#: Bytes that are hashed at once; windows of a run that are one row.
PIECE, RUN = 1 << 20, 256

_rng = np.random.default_rng(12)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _odd(WINDOW)
_BASE = int(_odd(1)[0])


def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: in lower case, whether it is a word's, its value in hashes. Digits, letters and whatever isn't ASCII make words."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.array([b >= 128 or 48 <= b < 58 or 97 <= b < 123 for b in lower.tolist()])
    return lower, word, np.where(word, _odd(256)[lower], np.uint64(0))


_LOWER, _WORD, _VALUE = _byte_tables()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


_POWER, _INVERSE = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a column of texts: raw (bytes), start and end of each, row (first word of each text), hashes."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = _WORD[self.raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut_at = at[(at > 0) & (at < len(inside))]
        begins[cut_at] |= inside[cut_at]
        ends[cut_at - 1] |= inside[cut_at - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(self.start, at)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A polynomial of each word's bytes, from running sums over pieces of the text; a word across pieces is the sum of its parts."""
        out = np.zeros(len(self.start), np.uint64)
        for lo in range(0, len(self.raw), PIECE):
            part = self.raw[lo : lo + PIECE]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[part] * _POWER[: len(part)], dtype=np.uint64)])
            a, b = np.searchsorted(self.end, lo, "right"), np.searchsorted(self.start, lo + len(part))
            if a == b:
                continue
            first, last = np.maximum(self.start[a:b] - lo, 0), np.minimum(self.end[a:b] - lo, len(part))
            scale = _INVERSE[first]
            if self.start[a] < lo:
                scale[0] = np.uint64(pow(_BASE, lo - int(self.start[a]), 1 << 64))
            out[a:b] += (sums[last] - sums[first]) * scale
        return _mix(out)

    def grams(self, n: int) -> np.ndarray:
        """A hash for each sequence of n words, wherever it starts; those that run into the next text are to be left out."""
        size = max(0, len(self.hash) - n + 1)
        out = np.full(size, n, np.uint64)
        for j in range(n):
            out += self.hash[j : j + size] * _PLACE[j]
        return _mix(out)

    def starts(self, n: int) -> np.ndarray:
        """Which of grams(n) lie inside one text."""
        size = max(0, len(self.hash) - n + 1)
        out = np.ones(size, bool)
        for e in self.row[1:-1]:
            out[max(0, e - n + 1) : e] = False
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprint of each window of WINDOW words, and which of them lie inside one text."""
        g, whole = self.grams(GRAM), self.starts(WINDOW)
        least = g[: len(whole)].copy()
        for j in range(1, WINDOW - GRAM + 1):
            np.minimum(least, g[j : j + len(whole)], out=least)
        return least, whole

    def text(self, a: int, b: int) -> str:
        """Words a to b - 1 in lower case with single blanks."""
        raw = _LOWER[self.raw[self.start[a] : self.end[b - 1]]].tobytes()
        base = int(self.start[a])
        return b" ".join([raw[s - base : e - base] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]).decode("utf-8", "replace")


def item_windows(items: DataFrame) -> DataFrame:
    """item, n (words), print, words: each different window of the benchmark's items."""

    def run(batches):
        for batch in slices(batches, 1):
            w = Words(batch.column(1))
            prints, _ = w.windows()
            rows = []
            for k, item in enumerate(batch.column(0).to_pylist()):
                a, b = int(w.row[k]), int(w.row[k + 1])
                if b - a >= WINDOW:
                    rows += [(item, WINDOW, prints[s], w.text(s, s + WINDOW)) for s in range(a, b - WINDOW + 1)]
                elif b > a:
                    rows.append((item, b - a, w.grams(b - a)[a], w.text(a, b)))
            item, n, prints, words = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(words, pa.string())], names=["item", "n", "print", "words"])

    named = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("null")).alias("item"), items["text"].cast("string").alias("text"))
    return cut(named.mapInArrow(run, "item string, n int, print long, words string").distinct(), "leak-windows")


def print_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter, a byte for eight bits by the fingerprints' highest bits, and the lengths of the windows that are shorter than WINDOW. What comes to the
    driver is a number for every 64 bits of the filter, whose size is bounded."""
    n = windows.select("print").distinct().count()
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (BITS_EACH * n).bit_length()))
    placed = windows.select(F.shiftrightunsigned("print", 64 - bits).alias("place"))
    cells = placed.groupBy(F.expr("place div 64").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 64 AS INT)))").alias("bits"))
    table = cells.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[table.column("cell").to_numpy()] = table.column("bits").to_numpy()
    lengths = [r["n"] for r in windows.where(F.col("n") < WINDOW).select("n").distinct().orderBy("n").collect()]  # nine at most
    return out.view(np.uint8), lengths


def _passes(known: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - (len(known).bit_length() + 2))
    return (known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def selected(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n_words, and n, print, at, words of a run of windows that may be the benchmark's: at is its first word's number.
    Each document has one row more, without a run."""
    known, lengths = print_filter(windows)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["doc_id", "th", "n_words", "n", "print", "at", "words"]

    def run(batches):
        for batch in slices(batches, 2):
            w = Words(batch.column(2))
            n_words = np.diff(w.row)
            found = []
            least, whole = w.windows()
            for n, prints, usable in [(WINDOW, least, whole), *[(n, w.grams(n), w.starts(n)) for n in lengths]]:
                s = np.flatnonzero(usable & _passes(shared.value, prints))
                if not len(s):
                    continue
                # neighbouring windows with one fingerprint are one run
                new = np.ones(len(s), bool)
                if n == WINDOW:
                    new[1:] = (np.diff(s) > 1) | (prints[s[1:]] != prints[s[:-1]])
                    # that of a word said over and over is written in parts
                    new |= (np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))) % RUN == 0
                a = s[new]
                b = s[np.append(np.flatnonzero(new)[1:], len(s)) - 1] + n
                row = np.searchsorted(w.row, a, "right") - 1
                row_end = w.row[row + 1]
                # a run does not go on into the next text: windows there are not usable, so there is a gap between
                found.append((row, np.full(len(a), n), prints[a], a - w.row[row], [w.text(x, y) for x, y in zip(a.tolist(), np.minimum(b, row_end).tolist())]))
            own = np.arange(batch.num_rows)
            rows = np.concatenate([own, *[f[0] for f in found]])
            empty = pa.nulls(batch.num_rows)
            tail = [pa.concat_arrays([empty.cast(kind), *[pa.array(f[k], kind) for f in found]]) for k, kind in ((1, pa.int32()), (3, pa.int64()), (4, pa.string()))]
            prints = pa.concat_arrays([empty.cast(pa.int64()), *[pa.array(f[2].view(np.int64)) for f in found]])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(n_words[rows].astype(np.int64)), tail[0], prints, tail[1], tail[2]], names=names)

    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), th.alias("th"), docs["text"].cast("string").alias("text"))
    return cut(given.mapInArrow(run, "doc_id long, th long, n_words long, n int, print long, at long, words string"), "leak-selected")


def spans(hits: Column) -> Column:
    """array<struct<at, n>> of hits, in order of at, as spans: what overlaps or touches is one."""
    none = F.array().cast("array<struct<at:long,n:long>>")

    def closed(acc: Column) -> Column:
        return F.when(acc["b"] > acc["a"], F.array_append(acc["out"], F.struct(acc["a"].alias("at"), (acc["b"] - acc["a"]).alias("n")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        end = x["at"] + x["n"]
        longer = F.struct(acc["a"].alias("a"), F.greatest(acc["b"], end).alias("b"), acc["out"].alias("out"))
        return F.when(x["at"] <= acc["b"], longer).otherwise(F.struct(x["at"].alias("a"), end.alias("b"), closed(acc).alias("out")))

    zero = F.lit(0).cast("long")
    return F.aggregate(hits, F.struct(zero.alias("a"), zero.alias("b"), none.alias("out")), step, closed)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (array of (at, n): words that the benchmark has too, by number from 0) and items (whose windows they are, by text
    order), one row for each row of docs."""
    windows = item_windows(items)
    rows = selected(docs, windows)
    runs = rows.where("print is not null")
    # the fingerprint join, then windows on both sides of it, word by word
    met = runs.join(windows.select("print").distinct(), "print", "left_semi")
    parts = F.split("words", " ")
    each = F.transform(F.sequence(F.lit(0), F.size("parts") - F.col("n")), lambda i: F.struct((F.col("at") + i).alias("at"), F.array_join(F.slice("parts", i + 1, F.col("n")), " ").alias("words")))
    opened = met.withColumn("parts", parts).select("doc_id", "th", "n", F.explode(each).alias("w")).select("doc_id", "th", F.col("n").cast("long").alias("n"), "w.at", "w.words")
    # windows that the same items have are one class, so that a document meets the items of a passage once
    whose = windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("class", F.md5(F.to_json("items")))
    whose = cut(whose, "leak-items")
    hits = cut(opened.join(whose.select("words", "class"), "words").select("doc_id", "th", "at", "n", "class").distinct(), "leak-hits")
    found = hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("hits"))
    classes = whose.select("class", "items").dropDuplicates(["class"])
    named = hits.select("doc_id", "th", "class").distinct().join(classes, "class").select("doc_id", "th", F.explode("items").alias("item"))
    named = named.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    known = found.join(named, same(found, named, "doc_id", "th")).select(found["doc_id"].alias("id_"), found["th"].alias("th_"), spans(F.col("hits")).alias("spans"), "items")
    own = rows.where("print is null").select("doc_id", "th", "n_words")
    known = cut(known, "leak-found")
    both = own.join(known, own["doc_id"].eqNullSafe(known["id_"]) & (own["th"] == known["th_"]), "left")
    none = F.array().cast("array<struct<at:long,n:long>>")
    return both.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All windows of all documents, of every length that the benchmark's windows have, against those.
ORACLE = f"""WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), {WINDOW}) AS n, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS words
      FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
    dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS words FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    h AS (SELECT DISTINCT doc_id, s, dw.n, item FROM dw JOIN iw USING (words)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
    g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id"""
