"""Removal of repeated 100-byte strings, decided by suffix arrays built by linear grouping.

The suffix array of a text comes from its Lyndon grouping (no recursion, no renaming): suffixes are
grouped by first byte; groups are taken in descending order, each member's previous smaller position
is found over the pointers of what was taken before, and the positions so pointed at are moved up
within their group by how many members point at them. The groups are then those of equal Lyndon
prefixes, and one pass from the least suffix emits the order within each.

Around it, what has to be sorted is cut down, exactly:

1. Anchors. In each document the least-hashed KGRAM-byte gram of every 100-byte window is an anchor;
   the windows that choose it are its own. Equal windows choose equal anchors, at one offset.
2. Anchors meet by hash. Those whose own windows are the same text as an earlier one's, by a second
   hash that shares nothing with the first (XXH64; a pair that meets and differs passes it once in
   2^64), are repeats as a whole. First anchors of a hash that is seen with different texts
   around go on; all others are done.
3. Their contexts meet by hash. Windows whose hash is there once are done; the runs of the rest,
   equal runs once, are the text whose suffix array is built: neighbours in it that share 100 bytes
   are one class, of which the first window in order of (doc_id, start) stays.
4. A hash with very many contexts is dealt out window by window, equal ones of a batch once: which
   windows go doesn't depend on the way they meet.

Batches keep one anchor of equal ones before the shuffle, so a text that a third of all rows share is
one row a batch. A hash that has more than its share of a batch's anchors, in different contexts, is
hot: its anchors are dealt by hash and context, a note of it goes to where its hash belongs, and its
contexts are dealt window by window everywhere. Contexts that meet are sorted by hash on disk and read
group by group. Removed spans are joined to the texts at the end.

Defined cases: a null text is an empty one; texts under 100 bytes lose nothing; a null id comes
before all others; rows equal in id and text are one document and get the same result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read

LENGTH = 100
KGRAM = 32
#: Different contexts of one hash beyond which they are dealt out window by window; and those in one batch, at least, that make it hot.
HOT, HOT_IN_BATCH = 4096, 8
#: Bytes of text for each partition of a shuffle, at most about.
PART_BYTES = 32 << 20
#: Bytes that one suffix array is built over, about.
ARRAY_BYTES = 1 << 18

_BASE = 0x100000001B3
_NULL = -(1 << 63)


def suffix_array(text: bytes) -> list[int]:
    """The suffix array by Lyndon grouping, in linear time."""
    n = len(text)
    if not n:
        return []
    at: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        at[c].append(i)
    members = [at[c] for c in sorted(at)]
    size = [len(own) for own in members]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = list(range(-1, len(members) - 1))  # the next lower group of each
    above = [*range(1, len(members)), -1]
    prev = [-1] * n
    taken = bytearray(n)
    g = len(members) - 1
    order = []
    while g >= 0:
        # members that have moved on are still listed
        own = members[g]
        if len(own) > 1:
            own = [s for s in own if group[s] == g]
            own.sort()
        order.append(own)
        count: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and taken[p]:
                p = prev[p]
            prev[s] = p
            taken[s] = 1
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if len(count) == 1:
            (p,) = count
            moved = {group[p]: {1: [p]}}
        else:
            moved = {}
            for p, k in count.items():
                by = moved.setdefault(group[p], {})
                if k in by:
                    by[k].append(p)
                else:
                    by[k] = [p]
        for h, by in moved.items():
            ks = sorted(by) if len(by) > 1 else list(by)
            rest = size[h]
            for k in ks:
                rest -= len(by[k])
            low = h
            for k in ks:
                own = by[k]
                if not rest and low == h:
                    rest = -1  # all of the group moves up: what moves least keeps its number
                    size[h] = len(own)
                    continue
                new = len(members)
                members.append(own)
                size.append(len(own))
                for p in own:
                    group[p] = new
                up = above[low]
                above.append(up)
                below.append(low)
                above[low] = new
                if up >= 0:
                    below[up] = new
                low = new
            if rest > 0:
                size[h] = rest
        g = below[g]
    order.reverse()
    front = [0] * len(members)
    start = 0
    for own in order:
        front[group[own[0]]] = start
        start += len(own)
    out = [-1] * n
    placed = bytearray(n)
    # the least suffix is the one after the end: what leads there begins the order
    s = n - 1
    while s >= 0 and not placed[s]:
        placed[s] = 1
        f = group[s]
        out[front[f]] = s
        front[f] += 1
        s = prev[s]
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            f = group[s]
            out[front[f]] = s
            front[f] += 1
            s = prev[s]
    return out


class Rolling:
    """64-bit hashes of all substrings of a text, from running sums and powers that are kept for many texts."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)
        self.table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(data):
            n = max(1 << 16, 2 * len(data))
            one = np.ones(1, np.uint64)
            self.power = np.cumprod(np.concatenate([one, np.full(n, _BASE, np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([one, np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.power[: len(data)])])

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        return _mix((sums[k:] - sums[:-k]) * self.inverse[: len(sums) - k])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slide(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over every w neighbours."""
    step = 1
    while 2 * step <= w:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def anchors(data: np.ndarray, rolling: Rolling, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first own window, last own window, hash of the own windows' text) of each anchor of a text of `length` bytes or more."""
    w = length - k + 1
    sums = rolling.sums(data)
    h = rolling.grams(sums, k)
    least = _slide(np.minimum, h, w)
    # places that are the least of some window, and for each window the first of them with its least hash
    cand = np.flatnonzero(_slide(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w) == h)
    nxt = np.searchsorted(cand, np.arange(len(least)))
    while True:
        wrong = h[cand[nxt]] != least
        if not wrong.any():
            break
        nxt[wrong] += 1
    first = np.flatnonzero(np.concatenate([[True], nxt[1:] != nxt[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(nxt) - 1]])
    place = cand[nxt[first]]
    # XXH64 of the bytes, which shares nothing with the rolling hash that the anchor was chosen by
    raw = memoryview(data)
    own = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
    shape = (place - first).astype(np.uint64) * np.uint64(1009) + (last - place + length).astype(np.uint64)
    return h[place], place, first, last, _mix(own + shape)


#: Rows are anchors (lo: from the anchor back to its first own window), or, told by lo, spans, notes of hot hashes, anchors of those (lo: _HOT - lo).
_SPAN = "h long, ctx long, doc long, th long, pos int, lo int, hi int"
_IS_SPAN, _NOTE, _HOT = -1, -2, -3
_NAMES = ["h", "ctx", "doc", "th", "pos", "lo", "hi"]
_TYPES = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]


def _rows(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t, copy=False)) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _split(h, ctx, doc, th, pos, lo, hi):
    """(first of each (h, ctx), the spans of the others), all in order of (h, ctx, doc, th, pos)."""
    order = np.lexsort((pos, th, doc, ctx, h))
    h, ctx, doc, th, pos, lo, hi = (x[order] for x in (h, ctx, doc, th, pos, lo, hi))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    # the same anchor twice (a repeated row) isn't a repeat of itself
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    twin = (doc == doc[lead]) & (th == th[lead]) & (pos == pos[lead])
    rest = ~new & ~twin
    return (h[new], ctx[new], doc[new], th[new], pos[new], lo[new], hi[new]), (doc[rest], th[rest], (pos - lo)[rest], (hi + lo)[rest])


def _span_rows(doc, th, start, size) -> pa.RecordBatch:
    """Spans travel among anchors: hi is the length."""
    return _rows(_mix(doc.astype(np.uint64) + th.astype(np.uint64)).view(np.int64), np.zeros(len(doc)), doc, th, start, np.full(len(doc), _IS_SPAN), size)


def _merged(doc, th, start, size):
    """The spans of each document joined where they touch."""
    if not len(doc):
        return doc, th, start, size
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order].astype(np.int64), (start + size)[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    run = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + run * (1 << 32)) - run * (1 << 32)
    cutp = new.copy()
    cutp[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(cutp)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], th[first], start[first], reach[last] - start[first]


def _concat(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(c) for c in zip(*parts))


def _starts(h: np.ndarray) -> np.ndarray:
    """Which of sorted hashes differ from the one before."""
    return np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]])


def _scan(length: int, k: int, parts: int, least: int):
    def run(batches):
        rolling = Rolling()
        for batch in batches:
            docs = batch.column(0).fill_null(_NULL).to_numpy()
            hashes = batch.column(1).to_numpy()
            found = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if text and len(text) >= length:
                    h, place, first, last, ctx = anchors(np.frombuffer(text, np.uint8), rolling, length, k)
                    n = len(h)
                    found.append((h.view(np.int64), ctx.view(np.int64), np.full(n, docs[i]), np.full(n, hashes[i]), place, place - first, last - place + length))
            if found:
                firsts, spans = _split(*_concat(found))
                h, lo = firsts[0], firsts[5]
                new = _starts(h)
                many = np.bincount(np.cumsum(new) - 1)
                hot = many > max(least, len(h) // (4 * parts))
                each = np.repeat(hot, many)
                yield _rows(*firsts[:5], np.where(each, _HOT - lo, lo), firsts[6])
                if hot.any():
                    note = np.flatnonzero(new)[hot]
                    yield _rows(*(c[note] for c in firsts[:5]), np.full(len(note), _NOTE), np.zeros(len(note)))
                if len(spans[0]):
                    yield _span_rows(*_merged(*spans))

    return run


def _group(hot: int):
    """One partition of hashes: spans of whole repeats, and the anchors whose contexts have to be compared (ctx: how many share the hash, or more than `hot`)."""

    def run(batches):
        held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not held:
            return
        cols = _concat(held)
        del held
        lo = cols[5]
        pick = lambda which: tuple(c[which] for c in cols)
        doc, th, start, size = (pick(lo == _IS_SPAN)[i] for i in (2, 3, 4, 6))
        noted = np.unique(cols[0][lo == _NOTE])
        apart = pick(lo <= _HOT)
        firsts, more = _split(*pick(lo >= 0))
        hots, rest = _split(*apart[:5], _HOT - apart[5], apart[6])
        h = firsts[0]
        many = np.bincount(np.cumsum(_starts(h)) - 1) if len(h) else np.zeros(0, int)
        many = np.where(np.isin(h, noted), hot + 1, np.repeat(many, many))
        go = many > 1
        if go.any():
            yield _rows(h[go], many[go], *(c[go] for c in firsts[2:]))
        if len(hots[0]):
            yield _rows(hots[0], np.full(len(hots[0]), hot + 1), *hots[2:])
        doc, th, start, size = _merged(*_concat([(doc, th, start, size), more, rest]))
        if len(doc):
            yield _span_rows(doc, th, start, size)

    return run


def _contexts(length: int, hot: int):
    """For each document its contexts: h, doc, th, start and bytes; of hot hashes windows, equal ones of a batch once."""

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            out, windows, spans = [], {}, []
            docs = batch.column(0).fill_null(_NULL).to_pylist()
            for doc, th, text, own in zip(docs, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for x in own:
                    a, b = x["pos"] - x["lo"], x["pos"] + x["hi"]
                    if x["ctx"] <= hot:
                        out.append((x["h"], doc, th, a, text[a:b]))
                        continue
                    sums = rolling.sums(np.frombuffer(text[a:b], np.uint8))
                    for k, key in enumerate(rolling.grams(sums, length).view(np.int64).tolist()):
                        w, me = text[a + k : a + k + length], (doc, th, a + k)
                        best = windows.setdefault((key, w), me)
                        if me != best:
                            windows[key, w] = min(me, best)
                            spans.append(max(me, best))
            out += [(key, *me, w) for (key, w), me in windows.items()]
            out += [(hash(s) & 0x7FFFFFFF, *s, None) for s in spans]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "doc", "th", "start", "bytes"])

    return run


def shared_windows(texts: list[bytes], places: list[tuple[int, int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """The windows of `texts` (each from its (doc, th, start) on) that an earlier one equals, by suffix arrays over the runs of candidate windows."""
    rolling = Rolling()
    hashes, text_of, at = [], [], []
    for i, t in enumerate(texts):
        g = rolling.grams(rolling.sums(np.frombuffer(t, np.uint8)), length)
        hashes.append(g)
        text_of.append(np.full(len(g), i, np.int32))
        at.append(np.arange(len(g), dtype=np.int32))
    hashes, text_of, at = np.concatenate(hashes), np.concatenate(text_of), np.concatenate(at)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    candidate = np.zeros(len(hashes), bool)
    candidate[order[1:][same]] = True
    candidate[order[:-1][same]] = True
    # runs of candidate windows of a text; equal runs are sorted once
    step = np.ones(len(hashes), bool)
    step[1:] = text_of[1:] != text_of[:-1]
    begin = np.flatnonzero(candidate & (step | ~np.concatenate([[False], candidate[:-1]])))
    finish = np.flatnonzero(candidate & np.concatenate([step[1:] | ~candidate[1:], [True]]))
    runs: dict[bytes, list[tuple[int, int, int]]] = {}
    for b, e in zip(begin.tolist(), finish.tolist()):
        i, a = int(text_of[b]), int(at[b])
        run = texts[i][a : int(at[e]) + length]
        doc, th, start = places[i]
        runs.setdefault(run, []).append((doc, th, start + a))
    gone: list[tuple[int, int, int]] = []
    firsts = {run: min(own) for run, own in runs.items()}
    for run, own in runs.items():
        for place in own:
            if place != firsts[run]:
                gone += [(place[0], place[1], place[2] + k) for k in range(len(run) - length + 1)]
    names = list(runs)
    # ends are told by place, not by the byte between
    joined = b"".join(r + b"\x00" for r in names)
    ends = np.cumsum([len(r) + 1 for r in names])
    order = np.array(suffix_array(joined), dtype=np.int64)
    which = np.searchsorted(ends, order, side="right")
    left = ends[which] - 1 - order  # bytes to the run's end
    order, which = order[left >= length], which[left >= length]
    classes: list[list[int]] = []
    last = None
    for p, w in zip(order.tolist(), which.tolist()):
        window = joined[p : p + length]
        if window == last:
            classes[-1].append((p, w))
        else:
            classes.append([(p, w)])
            last = window
    begins = ends - np.array([len(r) + 1 for r in names])
    for c in classes:
        if len(c) > 1:
            spots = sorted({(firsts[names[w]][0], firsts[names[w]][1], firsts[names[w]][2] + p - int(begins[w])) for p, w in c})
            gone += spots[1:]
    return gone


def _compare(length: int, array_bytes: int):
    """Contexts in order of their hash: spans of windows that are there before. Groups of one hash are put together up to array_bytes."""

    def found(texts, places, spans):
        spans = spans + (shared_windows(texts, places, length) if texts else [])
        if spans:
            doc, th, start = (np.array(c, dtype=np.int64) for c in zip(*spans))
            yield _span_rows(*_merged(doc, th, start, np.full(len(doc), length)))

    def run(batches):
        texts, places, spans, size, last, seen = [], [], [], 0, None, set()
        for batch in batches:
            for h, doc, th, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    last, seen = h, set()
                    if size >= array_bytes or len(spans) > 100_000:
                        yield from found(texts, places, spans)
                        texts, places, spans, size = [], [], [], 0
                if text is None:
                    spans.append((doc, th, start))
                elif (place := (doc, th, start)) not in seen:
                    seen.add(place)
                    texts.append(text)
                    places.append(place)
                    size += len(text)
        yield from found(texts, places, spans)

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH, k: int = KGRAM, hot: int = HOT, array_bytes: int = ARRAY_BYTES, hot_in_batch: int = HOT_IN_BATCH) -> DataFrame:
    """doc, th, pos, hi: spans (from pos, hi bytes long; they may overlap) whose bytes go. docs: doc, th, bytes."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("bytes"))).collect()[0][0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    found = docs.mapInArrow(_scan(length, k, parts, hot_in_batch), _SPAN)
    place = F.when(F.col("lo") <= _HOT, F.xxhash64("h", "ctx")).otherwise(F.col("h"))
    found = cut(found.repartition(parts, place).mapInArrow(_group(hot), _SPAN), "suffix-anchors")
    _release(spark)
    own = found.where("lo >= 0").groupBy(F.col("doc").alias("od"), F.col("th").alias("ot")).agg(F.collect_list(F.struct("h", "ctx", "pos", "lo", "hi")).alias("own"))
    some = docs.join(own, F.coalesce(F.col("doc"), F.lit(_NULL)).eqNullSafe(F.col("od")) & (F.col("th") == F.col("ot"))).select("doc", "th", "bytes", "own")
    contexts = some.mapInArrow(_contexts(length, hot), "h long, doc long, th long, start int, bytes binary")
    compared = cut(contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_compare(length, array_bytes), _SPAN), "suffix-compared")
    _release(spark)
    return found.where(F.col("lo") == _IS_SPAN).union(compared).select("doc", "th", "pos", "hi")


def _release(spark) -> None:
    """Let Spark's cleaner drop the shuffle files of what is cut: it does so as the driver collects its garbage, and else half an hour
    later. Nothing but disk depends on it."""
    gc.collect()
    spark._jvm.System.gc()


def _finish(batches):
    for batch in batches:
        out = []
        for text, starts, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            text = text or b""
            kept, at, gone, spans = [], 0, 0, 0
            end = -1
            for a, n in sorted(zip(starts or [], sizes or [])):
                if a > end:
                    spans += 1
                    kept.append(text[at:a])
                if a + n > end:
                    gone += a + n - max(a, end)
                    end = a + n
                    at = end
            kept.append(text[at:])
            out.append((len(text), gone, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = KGRAM, hot: int = HOT, array_bytes: int = ARRAY_BYTES, hot_in_batch: int = HOT_IN_BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("bytes"))
    spans = removed_spans(rows, length, k, hot, array_bytes, hot_in_batch)
    per = spans.groupBy(F.col("doc").alias("sd"), F.col("th").alias("st")).agg(F.collect_list(F.struct("pos", "hi")).alias("s"))
    both = rows.join(per, F.coalesce(F.col("doc"), F.lit(_NULL)).eqNullSafe(F.col("sd")) & (F.col("th") == F.col("st")), "left")
    return both.select("doc", "bytes", F.col("s.pos").alias("starts"), F.col("s.hi").alias("sizes")).mapInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents"))
