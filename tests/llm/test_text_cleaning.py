"""Toxicity, quality, HTML extraction and line dedup."""

import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.llm import html_blocks, line_dedup, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@given(st.lists(st.tuples(st.text("abc", min_size=2, max_size=6), st.booleans(), st.integers(0, 2)), min_size=1, max_size=4), st.lists(st.text("abcd", min_size=1, max_size=8), max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_is_edit_distance(terms, words):
    terms = tuple((t, whole, e if whole else 0) for t, whole, e in terms)
    a = toxicity.Automaton(terms)
    for w in words:
        near = [edits(t, w) for t, whole, most in terms if whole and edits(t, w) <= most] + [0 for t, whole, _ in terms if not whole and w.startswith(t)]
        hit = a.match(w)
        assert (hit is None) == (not near)
        if hit:
            text, whole, most = terms[hit[0]]
            assert hit[1] == min(near) and (edits(text, w) == hit[1] if whole else w.startswith(text))


def test_context_tells_quotation_from_abuse():
    m = toxicity.Model((("idiot", True, 1),), (1.0,), -3.0, (6.0, 0.3))
    s = m.scorer()
    assert s.score("you are such an idiot, go away") > 0.5 > s.score('she said that he wrote "an idiot" there')
    assert s.score("you are such an idoit, go iddiot") > s.score("fine words") and s.score(None) == s.score("")


def test_masked_and_excepted_words():
    m = toxicity.Model((("stupid", True, 1), ("moron", True, 1)), (1.0, 1.0), -3.0, (6.0, 0.3), frozenset({"oron"}))
    s = m.scorer()
    assert set(s.hits("st0pid morron oron stupid2day m*ron x2y it's stup")) == {"st0pid", "morron", "stupid", "m*ron"}
    assert s.score("you st0pid thing") == s.score("you stupit thing") < s.score("you stupid thing") and s.score("oron") == s.score("")


def score_by_hand(model, text):
    """The score with edit distances and windows counted one by one."""
    import re

    marks = [('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‹", "›"), ("‘", "’"), ("»", "«")]
    text = text or ""

    @functools.cache
    def hit(word):
        """(edits, term): the term itself, else the shortest beginning, else the nearest term."""
        near, began = [], []
        for k, (term, whole, most) in enumerate(model.terms):
            if whole and abs(len(term) - len(word)) <= most and edits(term, word) <= most and (term == word or word not in model.except_):
                near.append((edits(term, word), k))
            elif not whole and word.startswith(term):
                began.append((len(term), k))
        best = min(near, default=None)
        return best if best and best[0] == 0 or not began else (0, min(began)[1])

    spans = [m.span() for m in re.finditer(r"[^\W\d_]+(?:[\d*$@!]+[^\W\d_]+)*", text)]
    abuse = quotes = 0.0
    for i, (a, b) in enumerate(spans):
        word = text[a:b].lower()
        found = [hit(word)] if hit(word) is not None or word.isalpha() else [hit(p) for p in re.findall(r"[^\W\d_]+", word)]
        if not any(found):
            continue
        lo, hi = max(0, i - toxicity.WINDOW), min(len(spans) - 1, i + toxicity.WINDOW)
        before, after = text[spans[lo][0] : a], text[b : spans[hi][1] + 1]
        inside = any(o in before and c in after and (o != '"' or before.count(o) % 2) for o, c in marks)
        says = any(text[x:y].lower() in toxicity.SAYING for x, y in spans[lo : hi + 1])
        quoted = (0.7 + 0.3 * says) if inside else 0.0
        for d, k in filter(None, found):
            abuse += model.weights[k] * 0.85**d * (1 - quoted)
            quotes += model.weights[k] * 0.85**d * quoted
    z = model.bias + model.coef[0] * np.log1p(abuse) + model.coef[1] * np.log1p(quotes)
    return 1 / (1 + np.exp(-z))


def test_toxicity_query_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op1_toxicity(spark, folder).collect()
    assert model.terms and sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert abs(r["score"] - score_by_hand(model, texts[r["doc_id"]])) < 1e-9 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


@given(st.lists(st.sampled_from(["idiot", "idoit", "1diot", "idi0t", "id*ot", "IDIOTS", "idea", "said", "loser", "losr", "looser", "scumbag", "scum", '"', "“", "”", " ", " ", "x", "\n", "!"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_score_by_hand(parts):
    model = toxicity.Model((("idiot", True, 1), ("loser", True, 1), ("scum", False, 0)), (1.0, 1.0, 1.0), -3.0, (5.0, 0.3), frozenset({"looser"}))
    for text in ("".join(parts), " ".join(parts)):
        assert abs(model.scorer().score(text) - score_by_hand(model, text)) < 1e-9


def test_learning_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.learn(docs.repartition(1), labels) == toxicity.learn(docs.repartition(7, "text").union(docs.limit(9)), labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.op1_toxicity(spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    assert docs.count() == toxicity.op1_toxicity(spark, FOLDER).count()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) / len(rows) >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edges(spark, edge, empty):
    toxic = [(100 + i, 1 if i % 2 else 0, 1) for i in range(60)] + [(100, 0, None), (None, 1, 1)]
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int, quality int")
    for m in (toxicity.learn(edge, labels), toxicity.learn(edge, labels.limit(0)), toxicity.learn(empty, labels)):
        assert toxicity.score(edge, m).count() == edge.count() and toxicity.score(empty, m).count() == 0
    kept = toxicity.drop_toxic(edge, labels.limit(0))
    assert kept.columns == edge.columns and kept.count() == edge.count()


def base_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(5)}
    lines, dup, before = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.text(alphabet="ab \n#\t\x1c\x85é", max_size=120))
@settings(max_examples=400, deadline=None)
def test_base_counts(text):
    assert quality.base_counts(text) == base_by_hand(text)


@given(st.lists(st.text(alphabet="abcAB \né", max_size=40), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_grams_do_not_depend_on_their_place(texts):
    g = quality.Grams()
    together = g.of(texts)
    for i, t in enumerate(texts):
        for (b, f, e), (b1, f1, e1) in zip(together, g.of([t])):
            assert b[f[i] : e[i]].tolist() == b1[f1[0] : e1[0]].tolist()
    word = together[2]
    assert [int(e - f) for f, e in zip(word[1], word[2])] == [len(t.encode().split()) for t in texts]


def probability_by_hand(model, text):
    """The model's probability from n-grams that are cut and hashed one by one."""
    full = 1 << 64
    chars = [" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").lower()]
    words = [w for w in "".join(chars).split(" ") if w]

    def mixed(h, salt):
        h = (h + salt) * 0x9E3779B97F4A7C15 % full
        h ^= h >> 29
        return (h * 0x9E3779B97F4A7C15 % full) >> (64 - quality.BITS)

    def rolled(cs, first=0):
        h = 0
        for c in cs:
            h = (h * quality._BASE + ord(c) + first) % full
        return h

    # the hash of a word counts its last character highest
    each = [rolled(reversed(w), 1) for w in words]
    kinds = [[mixed(rolled(chars[i : i + n]), n) for i in range(len(chars) - n + 1)] for n in (3, 5)]
    kinds += [[mixed(h, 1) for h in each], [mixed((a * 0xD6E8FEB86659FD93 + b) % full, 2) for a, b in zip(each, each[1:])]]
    z = model.bias + sum(quality.SCALE * sum(float(model.weights[k]) for k in own) / len(own) for own in kinds if own)
    return 1 / (1 + np.exp(-(model.slope * z + model.shift)))


def test_verdicts_by_hand(spark, edge):
    weights = np.random.default_rng(3).normal(0, 0.5, 1 << quality.BITS).astype(np.float32)
    model = quality.Model(weights, 0.3, 0.9, -0.1)
    rows = [(i, t) for i, t in enumerate(["Ünïcode Ça É über " * 3 + "a b c d e f g", "日本 語 " * 4 + "\t x\ny z w v u", "Ab", "", None])]
    rows += [(r["doc_id"], r["text"]) for r in edge.where("length(text) < 3000").collect()]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), model).collect()
    for (_, text), r in zip(rows, out):
        p = probability_by_hand(model, text)
        n, _, _, _, again = base_by_hand(text or "")
        failed = n < 10 or 100 * again > 20 * n
        assert abs(r["probability"] - p) < 1e-4 and r["base_failed"] == failed
        assert abs(p - quality.THRESHOLD) < 1e-4 or r["kept"] == (not failed and p >= quality.THRESHOLD)


def test_quality_query_by_hand(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = quality.op5_quality(spark, folder).collect()
    assert model and sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n, chars, symbols, lines, again = base_by_hand(text or "")
        failed = n < 10 or 100 * again > 20 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, lines, again, failed)
        if len(text or "") < 5000:
            p = probability_by_hand(model, text)
            assert abs(r["probability"] - p) < 1e-4 and (abs(p - quality.THRESHOLD) < 1e-4 or r["kept"] == (not failed and p >= quality.THRESHOLD))


def test_quality_sample_is_bounded_by_counts(edge, spark):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    assert quality.fit(edge.union(edge), labels) is not None
    assert quality.fit(edge, labels, counts=100) is None and quality.fit(edge, labels, sample=5) is None


def test_quality_on_other_rows(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    part = [r for r in rows if r["doc_id"] % 3]
    m = quality.train([r["text"] for r in part], np.array([r["quality"] for r in part]))
    rest = [r for r in rows if r["doc_id"] % 3 == 0]
    grams = quality.Grams()
    p = np.concatenate([m.probabilities(m.logits(grams.of(h))) for _, _, h in quality.chunks([r["text"] for r in rest])])
    kept = [pi >= quality.THRESHOLD and not quality.base_fails(*np.array(quality.base_counts(r["text"]))[[0, 4]]) for pi, r in zip(p, rest)]
    assert sum(k == (r["quality"] == 1) for k, r in zip(kept, rest)) / len(rest) >= 0.85


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    for m in (quality.fit(edge, labels), quality.fit(edge, labels.limit(0)), quality.fit(empty, labels)):
        out = quality.judge(edge, m).collect()
        assert len(out) == edge.count() and all(not (r["base_failed"] and r["kept"]) for r in out)
        assert quality.judge(empty, m).count() == 0
    texts = {r["doc_id"]: r["text"] for r in edge.where("doc_id > 9").collect()}
    for r in out:
        if r["doc_id"] in texts:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_by_hand(texts[r["doc_id"]])


@pytest.fixture(scope="module")
def labeller():
    return html_blocks.train([], generated=500, epochs=8)


def agreement(model, pages):
    """The share of blocks of generated pages that get the label that the generator knows."""
    found, labels = zip(*map(html_blocks.marked, pages))
    said = html_blocks.label(model, list(found), html_blocks.Vectors())
    return np.mean(np.concatenate([np.array(y, bool) == ok for y, ok in zip(labels, said)]))


@pytest.mark.parametrize("layout", ["named", "bare", "table"])
def test_labeller_on_new_pages(labeller, layout):
    rng = np.random.default_rng(77)
    assert agreement(labeller, [html_blocks.generate(rng, layout) for _ in range(120)]) > 0.97


def test_labeller_on_layouts_that_it_never_saw(labeller):
    """In elements that no page of the training has, words, links and neighbours still tell; a labeller of pages with names alone doesn't know them."""
    rng = np.random.default_rng(78)
    centered = [html_blocks.generate(rng, "bare").replace("<div>", "<center>").replace("</div>", "</center>") for _ in range(120)]
    spans = [html_blocks.generate(rng, "table").replace("<table><tr>", "<div>").replace("</tr></table>", "</div>").replace("<td>", "<span>").replace("</td>", "</span><hr>") for _ in range(120)]
    named = html_blocks.train([], generated=500, epochs=8, write=lambda r: html_blocks.generate(r, "named"))
    for pages in (centered, spans):
        assert agreement(labeller, pages) > 0.96 and agreement(named, pages) < 0.8


def test_context_tells_what_no_name_does(labeller):
    body = "<p>Words of the main text go on here for some time, and more.</p><p>Second paragraph of the main text, with many words in it.</p>"
    pages = {
        f"<article><header><h1>The big title here</h1></header>{body}</article>": ["The big title here"],
        f'<table><tr><td>Menu<br><a href="/a">Home</a><br><a href="/b">About us</a></td><td><h1>The big title here</h1>{body}</td></tr></table>': ["The big title here"],
        f"<h1>The big title here</h1>{body}<h3>3 responses</h3><p>anna wrote may 4</p><p>nice text thanks.</p><p>bob says june 5</p><p>i do not agree.</p>": ["The big title here"],
        f"<header><p>Some site name</p></header><main>{body}</main>": [], f"<body>{body}</body>": [], f"<div>{body}</div>": [],
    }
    found = [html_blocks.blocks(page) for page in pages]
    for blocks, said, title in zip(found, html_blocks.label(labeller, found, html_blocks.Vectors()), pages.values()):
        assert [b.text for b, ok in zip(blocks, said) if ok] == [*title, "Words of the main text go on here for some time, and more.", "Second paragraph of the main text, with many words in it."]


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    model = html_blocks.Labeller.fresh(rng)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages = [rng.normal(size=(n, html_blocks.PATH_DIM + html_blocks.WORD_DIM + html_blocks.SIZES)) * 0.1 for n in (3, 5)]
    x, mask = html_blocks._pad(pages)
    x, mask = x.astype(np.float64), mask.astype(np.float64)
    y = (rng.random(mask.shape) > 0.5) * mask

    def loss():
        z = model.logits(x, mask)
        return float((mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum())

    grad = model.gradient(x, mask, y)
    for k, v in model.p.items():
        at = tuple(int(rng.integers(n)) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up = loss()
        v[at] = old - 1e-4
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-4 - grad[k][at]) < 1e-4 + 0.02 * abs(grad[k][at])


def test_blocks():
    page = "<title>no</title><p>a<b> b</b><br>c<p>d &amp; &eacute;&nbsp;e<script>var x='</p>';</script><div class='x'>f<!-- g --> h</div><style>p{}</style> tail<img src=x>"
    assert [b.text for b in html_blocks.blocks(page)] == ["a b c", "d & é e", "f h", "tail"]
    assert html_blocks.blocks(None) == [] == html_blocks.blocks("") and [b.text for b in html_blocks.blocks("plain < 5 words")] == ["plain < 5 words"]


def text_of(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_what_is_not_text():
    assert text_of('<article><p>a</p><script>document.write("<body>leak text")</script><p>b</p></article>') == ["a", "b"]
    assert text_of('<head><script>x("<body>leak")</script><title>t</title><style>p</style></head><body>in') == ["in"]
    assert text_of("<head><meta name=a><div>the head ends here</div>") == ["the head ends here"]
    assert text_of("a<svg><title>leak</title><text>leak</text></svg>b<template><p>leak</template>c<SCRIPT>leak</Script >d<!-- leak -->e<!-->f<? leak ?>g</3>h") == ["a", "b", "cdefgh"]
    assert text_of('<p title="a > b">c</p><p title=a"b>d</p><p>x < y > z &lt; w</p>') == ["c", "d", "x < y > z < w"]
    assert text_of("<p>a</p><script>leak") == ["a"] == text_of("<p>a</p><!-- leak") == text_of('<p>a</p><a href="leak')
    assert text_of('<p>a <a href="x>b</a> c</p><p>d</p>') == ["a b c", "d"]


@pytest.mark.parametrize("piece", ['<a "', "<p ", "<", "</", "<!", "<a b='", '<a ="', "<p>", "<div>x", "</div>", "<script>", "<!--", "&amp", "<svg>", "<head>", "= ", "<a =   "])
def test_reading_takes_linear_time(piece):
    import time

    html_blocks.blocks(piece * 1000)
    at = time.process_time()
    html_blocks.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - at < 6


def test_nesting_beyond_the_depth():
    found = html_blocks.blocks("<article>" + "<div>x" * 2000 + "</div>y" * 2000 + "<p>end</p></article><p>after")
    assert len(found) == 4002 and max(len(b.path) for b in found) == html_blocks.DEPTH and found[-1].path == ("p",) and found[-2].path == ("article", "p")


def test_long_pages_are_read_in_turns(labeller):
    rng = np.random.default_rng(5)
    found = html_blocks.blocks("".join(html_blocks.generate(rng) for _ in range(30)))
    vectors = html_blocks.Vectors()
    x, mask = html_blocks._pad([vectors.some(found, 0, len(found))])
    assert len(found) > 150 and np.allclose(labeller.long_logits(found, vectors, 50), labeller.logits(x, mask)[:, 0], atol=1e-3)


def test_training_reads_whole_pages_once_an_id(spark):
    page = "<article>" + "<p>word text.</p>" * 200 + "</article>"
    pages = spark.createDataFrame([(1, page)] * 50 + [(2, None), (3, "<p>b"), (None, page)], "page_id long, html string").repartition(3)
    assert sorted(len(x) for x, _ in html_blocks.sample_windows(pages)) == [1, 8, 64, 64, 64]
    assert len(html_blocks.sample_windows(pages, most=2)) == 2 and len(html_blocks.sample_windows(pages.limit(0))) == 0


def test_html_edges(spark, labeller):
    good = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>T</h1><p>Body text here.</p></article><footer>x</footer></body></html>"
    rows = [(1, "u", good), (1, "u", good), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<article>" + "<p>word text.</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    out = html_blocks.extract(pages, labeller).collect()
    texts = {}
    for r in out:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert texts[1] == ["T Body text here."] * 2 and texts[2] == [""] and texts[3] == [""] and texts[4][0].count("word text.") == 3000
    assert html_blocks.extract(pages.limit(0), labeller).count() == 0


def lines_by_hand(rows, least=50):
    """For each (doc_id, text): the lines that go. Every run of lines with words that is elsewhere earlier and has `least` words."""
    docs = sorted({(d if d is not None else -1, t) for d, t in rows if t is not None})
    own = [[(i, line, len(line.encode().split())) for i, line in enumerate(t.split("\n")) if line.encode().split()] for _, t in docs]
    seen, gone = {}, {}
    for k, lines in enumerate(own):
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= least:
                    run = tuple(x[1] for x in lines[a : b + 1])
                    if run in seen and seen[run] != (k, a):
                        gone.setdefault(k, set()).update(x[0] for x in lines[a : b + 1])
                    seen.setdefault(run, (k, a))
    return {docs[k]: "\n".join(x for i, x in enumerate(docs[k][1].split("\n")) if i not in lost) for k, lost in gone.items()}


@pytest.mark.parametrize("matches, reach", [(line_dedup.MATCHES, line_dedup.REACH), (3, 0), (1, 1)])
def test_line_dedup_by_hand(spark, matches, reach):
    rng = random.Random(9)
    pool = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([1, 2, 8, 20, 60]))) for _ in range(25)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows += [(200, "\n".join(["again and again"] * 60)), (201, "\n".join(["again and again"] * 70 + ["an end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = lines_by_hand(rows)
    assert want
    for r in line_dedup.dedup_lines(docs, matches=matches, reach=reach).collect():
        assert r["text"] == want.get((r["doc_id"], dict(rows)[r["doc_id"]]), dict(rows)[r["doc_id"]])


def test_matches_extend_both_ways(spark):
    """One window of a match is known; the lines around it are found equal by comparing them."""
    row = spark.createDataFrame([(list("abcdefg"), list("xbcdeyg"), [9, 20, 1, 30, 7, 8, 60])], "own array<string>, other array<string>, n array<int>")
    runs = row.select(line_dedup.equal_runs(F.col("own"), F.col("other"), F.col("n"), F.lit(10), 50).alias("r")).first()["r"]
    assert [tuple(r) for r in runs] == [(11, 14), (16, 16)]


def test_line_dedup_edges(edge, empty):
    out = line_dedup.dedup_lines(edge)
    assert out.columns == [*edge.columns, "n_lines_removed"]
    rows = out.collect()
    assert len(rows) == edge.count() and line_dedup.dedup_lines(empty).count() == 0
    want = lines_by_hand([(r["doc_id"], r["text"]) for r in edge.collect()])
    before = sorted(want.get((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]), r["text"]) or "" for r in edge.collect())
    assert sorted(r["text"] or "" for r in rows) == before
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert texts[7].count(" ") < 20 and texts[12] == "" and texts[1] is None


def test_line_dedup_is_native(spark):
    plan = line_dedup.op10_line_dedup(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and F is not None
