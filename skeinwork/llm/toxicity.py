"""Toxicity: Levenshtein automata intersected with a trie of learned terms, scored in context windows.

The terms are learned from labelled rows: whole words and word beginnings that toxic documents have
and others don't, counted over different documents (copies, told by a sketch, count once). A set
cover picks the terms that explain most toxic rows, until a further one explains too few; terms as
frequent as those follow. The trie of the terms and the Levenshtein automata of all of them (edits
allowed by length) run as one automaton, made deterministic as words need it: a state is a set of
(trie node, edits so far). A whole-word term matches a word within its edits, a beginning any word
that starts with it. Words may hold digits and signs that stand for letters; such a word that matches
no term is read as its parts.

A hit counts by its term's weight; a misspelled one counts a little less. The window of words around
it says how far it is quoted: quotation marks that enclose it, and words of saying. A logistic
regression over the sums of abuse and of quotation gives the document's score, about prior weights
that hold where labels say nothing. Words of clean rows that lie within a term's edits are no hits. A
term loses its edits if words near it that aren't known yet are to be expected in clean rows: the
share of near words that one clean row alone has says how often (Good and Turing). Labels, lang,
source and doc_id are never inputs of a score.

Defined cases: a null or empty text has the score of a text without hits; without labels of both
kinds, or without a term that tells them apart, all scores are 0.12; several labels of one document
count as their largest, and of several texts under one id one is learned from (that of the least
hash); repeated rows get the same score; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read, slices

#: Candidates that a task counts before it passes the counts on.
HELD = 50_000
#: Labelled rows that terms and weights are learned from, at most: those whose ids hash lowest.
SAMPLE = 8000
#: What a term needs: toxic rows, how many times the share of clean rows, and of the best term's rows what the cover's last one adds.
LEAST_ROWS, LEAST_RATIO, LEAST_COVER = 4, 12, 0.02
#: Clean rows with a near word that no other row has, of all clean rows, beyond which a term allows no edits.
MOST_UNKNOWN = 0.0005
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Words before and after a hit that its context is read from.
WINDOW = 8
BEGINNINGS = range(4, 9)
_WORD = re.compile(r"[^\W\d_]+(?:[\d*$@!]+[^\W\d_]+)*")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Words that introduce another's words, in the languages at hand.
SAYING = frozenset("said says wrote writes quote quoted quotes called reported told dit disait écrit cité sagte sagt schrieb zitat zitiert dijo dice escribió cita".split())
_OPEN, _CLOSE = '"“„«‹‘»', '"”“»›’«'
#: Prior weights of the regression: intercept, abuse, quotation.
PRIOR = np.array([-3.0, 5.0, 0.3])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def edits(term: str, whole: bool) -> int:
    """Edits that a term allows: beginnings are matched exactly, as are short words."""
    return (0 if len(term) < 5 else 1 if len(term) < 9 else 2) if whole else 0


@dataclass
class Automaton:
    """The deterministic product of the trie with its terms' Levenshtein automata, built lazily."""

    terms: tuple[tuple[str, bool, int], ...]  # (text, whole word?, edits that it allows)
    except_: frozenset[str] = frozenset()  # words that are no misspellings
    nodes: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    reach: list[int] = field(default_factory=lambda: [0])  # the most edits that a term below a node allows
    states: dict[frozenset, int] = field(default_factory=dict)
    sets: list[frozenset] = field(default_factory=list)
    moves: list[dict[str, int]] = field(default_factory=list)
    found: list[tuple[int, int]] = field(default_factory=list)  # of a state, if the word ends there
    began: list[int] = field(default_factory=list)  # of a state: a beginning that is complete here, or -1
    words: dict[str, tuple[int, int] | None] = field(default_factory=dict)

    def __post_init__(self):
        for k, (text, _, most) in enumerate(self.terms):
            at = 0
            self.reach[0] = max(self.reach[0], most)
            for c in text:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.nodes[at][c]
                self.reach[at] = max(self.reach[at], most)
            self.ends[at].append(k)
        self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        """The number of a set of positions, closed under missing characters."""
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            for child in self.nodes[node].values():
                if e < self.reach[child] and (child, e + 1) not in positions:
                    positions.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in positions:
            least[node] = min(e, least.get(node, e))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, k) for node, e in key for k in self.ends[node] if e <= self.terms[k][2]]
            self.found.append(min(hits, default=(0, -1))[::-1])
            self.began.append(min((k for e, k in hits if e == 0 and not self.terms[k][1]), default=-1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nxt = set()
        for node, e in self.sets[state]:
            child = self.nodes[node].get(c)
            if child is not None:
                nxt.add((child, e))
            if e < self.reach[node]:
                nxt.add((node, e + 1))  # an added character
            for child in self.nodes[node].values():
                if e < self.reach[child]:
                    nxt.add((child, e + 1))  # another character
        self.moves[state][c] = out = self._state(nxt)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term that a lower-case word is, or None."""
        if word in self.words:
            return self.words[word]
        at, hit = 0, None
        for c in word:
            nxt = self.moves[at].get(c)
            at = self._move(at, c) if nxt is None else nxt
            if not self.sets[at]:
                break
            if self.began[at] >= 0:
                hit = hit or (self.began[at], 0)
        else:
            k, e = self.found[at]
            if k >= 0 and (hit is None or e == 0) and (e == 0 or word not in self.except_):
                hit = (k, e)
        if len(self.words) > 200_000:  # a memo, not a limit: words are matched anew
            self.words.clear()
        self.words[word] = hit
        return hit


@dataclass
class Model:
    terms: tuple[tuple[str, bool, int], ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = -2.0
    coef: tuple[float, ...] = (0.0, 0.0)
    except_: frozenset[str] = frozenset()

    def scorer(self) -> Scorer:
        return Scorer(self, Automaton(self.terms, self.except_))


@dataclass
class Scorer:
    model: Model
    automaton: Automaton

    def hits(self, text: str) -> dict[str, tuple[int, int]]:
        """The text's different words that match a term; of words with signs in them that match none, the parts that do."""
        match, words = self.automaton.match, self.automaton.words
        out = {}
        for w in set(_WORD.findall(text.lower())):
            hit = words[w] if w in words else match(w)
            if hit is not None:
                out[w] = hit
            elif not w.isalpha():
                for part in _PLAIN.findall(w):
                    hit = match(part)
                    if hit is not None:
                        out[part] = hit
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Sums, damped by their logarithm, of the hits' weights as abuse and as quotation."""
        text = text or ""
        hits = self.hits(text)
        if not hits:
            return 0.0, 0.0
        spans = [m.span() for m in _WORD.finditer(text)]
        abuse = quotes = 0.0
        for i, (a, b) in enumerate(spans):
            word = text[a:b].lower()
            found = [hits[word]] if word in hits else [] if word.isalpha() else [hits[p] for p in _PLAIN.findall(word) if p in hits]
            for k, e in found:
                weight = self.model.weights[k] * 0.85**e
                quoted = self.quotation(text, spans, i)
                abuse += weight * (1 - quoted)
                quotes += weight * quoted
        return math.log1p(abuse), math.log1p(quotes)

    @staticmethod
    def quotation(text: str, spans: list[tuple[int, int]], i: int) -> float:
        """How far the word stands in a quotation, 0 to 1: 0.7 for marks on both sides in its window, 0.3 for a word of saying."""
        first, last = max(0, i - WINDOW), min(len(spans) - 1, i + WINDOW)
        before, after = text[spans[first][0] : spans[i][0]], text[spans[i][1] : spans[last][1] + 1]
        inside = any(before.rfind(o) >= 0 and after.find(c) >= 0 and (o != '"' or before.count('"') % 2 == 1) for o, c in zip(_OPEN, _CLOSE))
        says = any(text[a:b].lower() in SAYING for a, b in spans[first : last + 1])
        return 0.7 * inside + 0.3 * says if inside else 0.0

    def score(self, text: str | None) -> float:
        z = self.model.bias + sum(c * x for c, x in zip(self.model.coef, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _candidates(text: str) -> set[str]:
    """A text's words ("w$") and beginnings of words ("w")."""
    out = set()
    for w in set(_PLAIN.findall(text.lower())):
        if len(w) >= 3:
            out.add(w + "$")
        out.update(w[:n] for n in BEGINNINGS if n <= len(w))
    return out


def _sketch(text: str) -> int:
    """Equal for copies and, mostly, near copies: the least hash of the text's 6-word runs."""
    words = text.encode("utf-8", "surrogatepass").split()
    return min((zlib.crc32(b" ".join(words[i : i + 6])) for i in range(max(1, len(words) - 5))), default=0)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, y, first: at most `sample` labelled rows outside the held-out fold, one for each id; first: of those with its label and sketch the first."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    picked = known.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "of")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max(F.col("y") > 0).alias("toxic"))

    def sketch(batches):
        for batch in batches:
            yield batch.append_column("sketch", pa.array([_sketch(t) for t in batch.column(1).to_pylist()], pa.int64()))

    rows = cut(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("y")).mapInArrow(sketch, "doc_id long, text string, y int, sketch long"), "toxicity-sample")
    # a group of copies is one row before it is shuffled; `sample` rows at most
    firsts = rows.groupBy("sketch", "y").agg(F.min("doc_id").alias("at")).select("at")
    marked = rows.join(F.broadcast(firsts), F.col("doc_id") == F.col("at"), "left")
    return cut(marked.select("doc_id", "text", "y", F.col("at").isNotNull().alias("first")), "toxicity-rows")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Terms and weights from at most `sample` labelled rows outside the held-out fold."""
    rows = sampled(docs, labels, sample)
    totals = {bool(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model()

    def told(tox: Counter, non: Counter) -> pa.RecordBatch:
        keys = list(tox | non)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()), pa.array([non[k] for k in keys], pa.int64())], names=["term", "tox", "non"])

    def count(batches):
        tox, non = Counter(), Counter()
        for batch in slices(batches, 0):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (tox if y else non).update(_candidates(text))
                if len(tox) + len(non) > HELD:
                    yield told(tox, non)
                    tox.clear()
                    non.clear()
        yield told(tox, non)

    per = rows.where("first").select("text", "y").mapInArrow(count, "term string, tox long, non long").groupBy("term").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"))
    ratio = (F.col("tox") / totals[True]) / ((F.col("non") + 0.5) / totals[False])
    per = per.where((F.col("tox") >= LEAST_ROWS) & (ratio >= LEAST_RATIO) & (F.col("tox") >= 9 * F.col("non")))
    # words that LEAST_ROWS rows of the sample share
    best = [r["term"] for r in per.orderBy(F.col("tox").desc(), "term").collect()]
    return _choose(rows, best)


def _choose(rows: DataFrame, best: list[str]) -> Model:
    """Set cover over the candidates that each sampled row has, then the regression."""
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(best))

    def which(batches):
        for batch in batches:
            terms = [sorted(_candidates(t) & shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(terms, pa.list_(pa.string()))], names=["doc_id", "y", "terms"])

    table = rows.where("first").select("doc_id", "text", "y").mapInArrow(which, "doc_id long, y int, terms array<string>").toPandas()
    table = table.sort_values("doc_id", kind="stable")
    toxic = [frozenset(t) for t in table[table["y"] > 0]["terms"]]
    clean = Counter(t for terms in table[table["y"] == 0]["terms"] for t in terms)
    support = Counter(t for terms in toxic for t in terms)
    fit = [t for t in best if support[t] >= LEAST_ROWS and clean[t] <= support[t] / LEAST_RATIO]
    some, seeds, left = set(fit), [], toxic
    while left:
        gain = Counter(t for terms in left for t in terms if t in some)
        # most rows first; among equals the longest beginning, then the whole word
        t = max(gain, key=lambda t: (gain[t], len(t.rstrip("$")), t.endswith("$"), t), default=None)
        if t is None or gain[t] < LEAST_ROWS or (seeds and gain[t] < LEAST_COVER * support[seeds[0]]):
            break
        seeds.append(t)
        left = [terms for terms in left if t not in terms]
    if not seeds:
        return Model()
    floor = max(4.0, 0.2 * float(np.median([support[t] for t in seeds])))
    chosen: list[str] = []
    for t in [*seeds, *sorted((t for t in fit if support[t] >= floor), key=lambda t: (-support[t], len(t), t))]:
        stem = t.rstrip("$")
        if t not in chosen and not any(not c.endswith("$") and stem.startswith(c) for c in chosen):
            chosen.append(t)
    # a beginning that one whole word makes up is that word
    chosen = [t + "$" if not t.endswith("$") and support.get(t + "$", 0) >= 0.9 * support[t] else t for t in chosen]
    longest = {t: max((u for u in fit if u.endswith("$") and u.startswith(t) and support[u] >= 0.9 * support[t]), key=len, default=t) for t in chosen if not t.endswith("$")}
    chosen = list(dict.fromkeys(longest.get(t, t) for t in chosen))
    terms = tuple((t.rstrip("$"), t.endswith("$"), edits(t.rstrip("$"), t.endswith("$"))) for t in chosen)
    n1, n0 = len(toxic), max(1, len(table) - len(toxic))
    logs = [math.log(((support[t] + 0.5) / (n1 + 1)) / ((clean[t] + 0.5) / (n0 + 1))) for t in chosen]
    weights = tuple(min(1.5, max(0.5, x / max(1e-9, float(np.median(logs))))) for x in logs)
    model = Model(terms, weights)
    return _regress(rows, model)


def _near_words(rows: DataFrame, model: Model) -> tuple[frozenset[str], set[int]]:
    """(words of clean rows within a term's edits, terms that such words are too frequent near)."""

    def near(batches):
        scorer = model.scorer()
        for batch in batches:
            found = Counter()
            for text in batch.column(0).to_pylist():
                found.update((w, k) for w, (k, e) in scorer.hits(text).items() if e)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([found[x] for x in keys], pa.int64())], names=["word", "term", "n"])

    clean = rows.where("first and y = 0").select("text")
    words = clean.mapInArrow(near, "word string, term int, n long").groupBy("word", "term").agg(F.sum("n").alias("n")).collect()
    once = Counter(r["term"] for r in words if r["n"] == 1)
    total = clean.count()
    return frozenset(r["word"] for r in words), {k for k, n in once.items() if n > max(1, MOST_UNKNOWN * total)}


def _regress(rows: DataFrame, model: Model) -> Model:
    except_, crowded = _near_words(rows, model)
    terms = tuple((t, whole, 0 if k in crowded else most) for k, (t, whole, most) in enumerate(model.terms))
    model = Model(terms, model.weights, except_=except_)
    rows = rows.select("doc_id", "text", "y")

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            f = [scorer.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array([x[k] for x in f], pa.float64()) for k in range(2)]], names=["doc_id", "y", "a", "b"])

    table = rows.mapInArrow(run, "doc_id long, y int, a double, b double").toPandas().sort_values("doc_id", kind="stable")
    x, y = table[["a", "b"]].to_numpy(), table["y"].to_numpy(dtype=float)
    w, pull = PRIOR.copy(), np.array([0.01, 2.0, 2.0])
    full = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -40, 40)))
        g = full.T @ (p - y) + pull * (w - PRIOR)
        h = (full * (p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(pull)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(terms, model.weights, float(w[0]), tuple(float(max(0.0, v)) for v in w[1:]), except_)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def run(batches):
        scorer = model.scorer()
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score `threshold` or more; all columns pass through, whatever their names and kinds. Only texts go to Python."""
    model = learn(docs, labels)

    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for part in parts:
            own = slices([pa.record_batch([part], ["text"])], 0)
            yield pa.array([scorer.score(t) < threshold for x in own for t in x.column(0).to_pylist()], pa.bool_())

    return docs.where(clean(F.col("text").cast("string")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
