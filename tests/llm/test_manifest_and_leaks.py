"""The Merkle manifest and benchmark decontamination, against plain counts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.llm import decontamination as dec
from skeinwork.llm import merkle

H = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
FIELD = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
LOWER = str.maketrans(merkle._UPPER, merkle._LOWER)


def tree_by_hand(leaves, arity):
    """(root, for each leaf the siblings level by level)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    proofs = []
    for k in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            lo = k // arity * arity
            steps.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + arity])))
            k //= arity
        proofs.append(steps)
    return levels[-1][0], proofs


def manifest_by_hand(rows, arity=8):
    """(doc_id, leaf, subroot, root, siblings) of (doc_id, source, lang, n_chars, text), sorted."""
    leaf = lambda r: H("".join(map(FIELD, r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted(((r[0], leaf(r)) for r in rows if r[2] == x), key=lambda p: (p[0] is not None, p[0] or 0, p[1])) for x in langs}
    low = {x: tree_by_hand([d for _, d in of[x]], arity) for x in langs}
    root, above = tree_by_hand([low[x][0] for x in langs], arity)
    out = []
    for x, up in zip(langs, above):
        for (doc, own), steps in zip(of[x], low[x][1]):
            out.append((doc, own, low[x][0], root, "".join(a + b for a, b in steps + up)))
    return sorted(out, key=repr)


def manifest_rows(df):
    found = df.select("doc_id", "leaf", "subroot", "root", F.array_join(F.transform("proof", lambda p: F.concat(p["before"], p["after"])), "").alias("s"), (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert all(r["ok"] for r in found)
    return sorted([tuple(r)[:5] for r in found], key=repr)


def test_manifest_of_odd_rows(spark, edge, empty):
    docs = edge.withColumns({"at": F.lit(3), "tree": F.lit("x"), "digest": F.lit(0), "up": F.lit(1), "m": F.lit(2)})
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") == 5, "alone").otherwise(F.col("lang")))
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    for arity in (8, 2):
        assert manifest_rows(merkle.manifest(docs, arity=arity)) == manifest_by_hand(rows, arity)
    assert merkle.manifest(empty).count() == 0
    one = docs.where("doc_id = 5")
    assert manifest_rows(merkle.manifest(one)) == manifest_by_hand([r for r in rows if r[0] == 5]) and merkle.manifest(one).first()["proof"] == []


def test_many_trees_and_repeated_rows(spark):
    """More languages than a node has children, one of them most of all rows; one row a third of them."""
    rows = [(i % 97 if i % 3 else 5, "s", None if i % 11 == 0 else ("most" if i % 2 or i % 3 == 0 else f"l{i % 31}"), i % 3, "t" if i % 3 == 0 else f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert manifest_rows(merkle.manifest(docs)) == manifest_by_hand(rows)


def test_tampering_shows(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in merkle.op11_merkle(spark, folder).collect():
        text = docs[r["doc_id"]]["text"]
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None and text.translate(LOWER) != text
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


# decontamination


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def leaks_by_hand(docs, items, window=10):
    """Sorted (doc_id, n_words, hit words, items) by comparing every window with every other."""
    wanted = {}
    for item, text in items:
        w = words_by_hand(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[s : s + n]), set()).add("null" if item is None else str(item))
    lengths = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w, hit, whose = words_by_hand(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wanted:
                    hit |= set(range(s, s + n))
                    whose |= wanted[tuple(w[s : s + n])]
        out.append((doc, len(w), sorted(hit), sorted(whose)))
    return sorted(out, key=repr)


def leak_rows(df):
    return sorted([(r["doc_id"], r["n_words"], [p for s in r["spans"] for p in range(s["at"], s["at"] + s["n"])], r["items"]) for r in df.collect()], key=repr)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB1é_ .\x00日\n"), max_size=60)), max_size=12), st.integers(1, 9), st.sampled_from([7, 64, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_words_of_a_batch(texts, n, piece):
    whole, dec.PIECE = dec.PIECE, piece
    try:
        w = dec.Words(pa.array(["skipped", *texts], pa.string()).slice(1))
    finally:
        dec.PIECE = whole
    own = [words_by_hand(t) for t in texts]
    flat = [x for t in own for x in t]
    assert [w.text(i, i + 1) for i in range(len(w.start))] == flat and np.diff(w.row).tolist() == [len(t) for t in own]
    # equal words and sequences have equal hashes, others don't
    assert len({(a, b) for a, b in zip(flat, w.hash.tolist())}) == len(set(flat)) == len(set(w.hash.tolist()))
    g = w.grams(n).tolist()
    assert [i for i, ok in enumerate(w.starts(n)) if ok] == [w.row[k] + s for k, t in enumerate(own) for s in range(len(t) - n + 1)]
    assert len(set(zip(g, [tuple(flat[i : i + n]) for i in range(len(g))]))) == len(set(g))


def test_leaks_of_odd_rows(spark, edge, empty):
    rng = random.Random(3)
    texts = [r["text"] for r in edge.select("text").collect() if r["text"]]
    cut_out = lambda t, n: " ".join(t.split()[3 : 3 + n])
    items = [(i, cut_out(rng.choice(texts), rng.randint(1, 40))) for i in range(40)] + [(None, cut_out(texts[0], 30)), (7, None), (8, ""), (9, " ,.; "), (3, "é ü"), (3, texts[5][:400].upper()), (11, "One"), (12, "ab " * 30)]
    items += [(100 + i, cut_out(texts[2], 25)) for i in range(30)]
    bench = spark.createDataFrame([(a, b, 1, 2) for a, b in items], "item_id long, text string, print long, words int").repartition(3)
    docs = edge.withColumns({"words": F.lit(1), "print": F.lit(2), "items": F.lit("x"), "at": F.lit(0), "n": F.lit(1)})
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    wanted = leaks_by_hand(rows, items)
    assert any(r[2] for r in wanted) and leak_rows(dec.contamination(docs, bench)) == wanted
    assert leak_rows(dec.contamination(docs, bench.limit(0))) == leaks_by_hand(rows, [])
    assert dec.contamination(empty, bench).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """With a filter too small for the benchmark, whatever it lets through is found out by the joins."""
    monkeypatch.setattr(dec, "FILTER_BITS", (7, 7))
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    by_hand = leaks_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert leak_rows(dec.contamination(docs, items)) == by_hand


def test_one_word_over_and_over(spark):
    docs = spark.createDataFrame([(1, "ab " * 3000 + "c"), (2, "c " + "ab " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab " * 12), (2, "ab ab c")], "item_id long, text string")
    assert leak_rows(dec.contamination(docs, items)) == [(1, 3001, list(range(3001)), ["1", "2"]), (2, 10, [], [])]
