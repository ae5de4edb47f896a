"""Chunking, entities and relationships against plain Python statements of the same rules."""

import re

import numpy as np

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions.text import find_spans, float_text, is_number, norm, strip
from skeinwork.operators import chunking, embedding, entities, relations, text_model
from skeinwork.operators.entities import CAPITALISED
from skeinwork.sources import fixtures as fx

TEXTS = st.text(alphabet="ab. ?!\nA éZ9\t", max_size=80)


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "s", f"{i:04d}", t) for i, t in enumerate(texts)], "chunk_id string, source_doc string, ord string, text string")


@given(TEXTS, st.integers(1, 30), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_fixed_size_ends_and_covers(text, size, overlap):
    out = chunking._fixed(text, size, overlap)
    assert [c[0] for c in out] == list(range(len(out)))
    for _, body, a, b, _ in out:
        assert body == text[a:b].strip() and 0 < b - a <= size
    covered = set()
    for _, _, a, b, _ in out:
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_fixed_size_ends_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert chunking.fixed_size(docs).select("doc_id").distinct().count() == docs.where(strip(F.col("text")) != "").count()


def test_fixed_size_rules():
    assert [c[1] for c in chunking._fixed("One. Two three four five", 12, 2)] == ["One.", "e.", "Two three", "ee four five"]
    assert chunking._fixed("", 5, 1) == []


@given(st.lists(st.sampled_from(["aa. bb", "c" * 7, " ", "d?", "e" * 25]), max_size=6))
@settings(max_examples=100, deadline=None)
def test_paragraphs_fold(parts):
    out = chunking._paragraphs("\n\n".join(parts), 10)
    whole = [c for c in out if c[4] == "semantic"]
    assert "".join(c[1].replace("\n\n", "") for c in whole) == "".join(p.strip() for p in parts if p.strip() and len(p.strip()) <= 10)


def test_sentences(spark):
    docs = spark.createDataFrame([(1, "A b. C d! E f? G h. I"), (2, ""), (3, None), (4, "One only")], "doc_id long, text string")
    rows = [tuple(r) for r in chunking.sentences(docs).orderBy("doc_id", "chunk_index").collect()]
    assert rows == [(1, 0, "A b. C d! E f?", 0, 3, "sentence"), (1, 1, "E f? G h. I", 2, 5, "sentence"), (1, 2, "I", 4, 5, "sentence"), (4, 0, "One only", 0, 1, "sentence")]
    with pytest.raises(ValueError):
        chunking.sentences(docs, 2, 2)


def test_csv_rows_with_missing_values(spark):
    rows = spark.createDataFrame([(0, "x", None)], "i int, a string, b string")
    assert chunking.csv_rows(rows, ["a", "b"], "i").first()["text"] == "a: x, b: None"
    assert chunking.csv_rows(rows, ["a", "b"], "i", "json").first()["text"] == '{"a": "x", "b": null}'
    with pytest.raises(ValueError):
        chunking.csv_rows(rows, ["a"], "i", "xml")
    with pytest.raises(ValueError):
        chunking.chunker("other")


@given(st.lists(TEXTS, min_size=1, max_size=8))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_spans_are_finditers(spark, texts):
    rows = chunks(spark, *texts).select("text", find_spans(F.col("text"), CAPITALISED).alias("m")).collect()
    python = CAPITALISED.replace("(?U:\\s)", "\\s")
    for r in rows:
        assert [tuple(m) for m in r["m"]] == [(m.group(), m.start(), m.end()) for m in re.finditer(python, r["text"])]


def test_keyword_entities_stop_words_and_toggles(spark):
    c = chunks(spark, "The Big Apple cost 12.5 at a.b@c.org see https://x.example.com/p?q=1 XApple", None)
    found = [(r["type"], r["text"]) for r in entities.keyword_entities(c).orderBy("ord").collect()]
    assert found == [("NAMED_ENTITY", "The Big Apple"), ("EMAIL", "a.b@c.org"), ("URL", "https://x.example.com/p?q=1"), ("NUMBER", "12.5"), ("NUMBER", "1")]
    assert {r["type"] for r in entities.keyword_entities(c, False, False, False).collect()} == {"NAMED_ENTITY"}


@pytest.mark.parametrize("text, source, target", [("Income", "ORGANIZATION", "ORGANIZATION"), ("Blue Sky", "ORGANIZATION", "PRODUCT"), ("ERP", "TECHNOLOGY", "TECHNOLOGY"), ("Domestic", "ORGANIZATION", "PRODUCT"), ("the community", "DEPARTMENT", "DEPARTMENT"), ("x1", "ENTITY", "ENTITY")])
def test_classify(spark, text, source, target):
    row = spark.range(1).select(entities.classify(F.lit(text), True), entities.classify(F.lit(text), False)).first()
    assert tuple(row) == (source, target)


def test_metric_coercion(spark):
    values = ["2023.0", "12d", "1_000", "nan", "", "15000000", " 7 ", None]
    rows = spark.createDataFrame([(f"c{i}", "s", str(i), "a", "r", "b", "entity", v) for i, v in enumerate(values)], "chunk_id string, source_doc string, ord string, source string, relation string, target string, target_type string, value string")
    found = {r["chunk_id"]: r["text"] for r in entities.row_entities(rows).where("type = 'METRIC'").collect()}
    assert found == {"c0": "2023.0", "c5": "15000000.0", "c6": "7.0"}


def test_float_text(spark):
    for x, want in ((0.5, "0.5"), (12345678.25, "12345678.25"), (1e15, "1000000000000000.0"), (3.0, "3.0"), (0.0, "0.0")):
        assert spark.range(1).select(float_text(F.lit(x))).first()[0] == want == str(x)


def test_sections_with_content(spark):
    rows = spark.createDataFrame([("c", "s", "0", "Sec", "Sub", "2023.0", None, "Blue Sky and Acme Inc", "a, ,b")], "chunk_id string, source_doc string, ord string, section string, subsection string, year string, perspective string, content string, tags string")
    found = [(r["type"], r["text"], r["column"]) for r in entities.row_entities(rows).orderBy("ord").collect()]
    assert found == [("SECTION", "Sec", "section"), ("SUBSECTION", "Sub", "subsection"), ("YEAR", "2023", "year"), ("TAG", "a", "tags"), ("TAG", "b", "tags"), ("PRODUCT", "Blue Sky", "content"), ("ORGANIZATION", "Acme Inc", "content")]
    said = [(r["source"], r["target"], r["type"]) for r in relations.table_relations(rows, entities.row_entities(rows)).collect()]
    assert ("Sub", "Blue Sky", "MENTIONS_PRODUCT") in said and ("Sec", "Sub", "HAS_SUBSECTION") in said and ("Sub", "2023", "IN_YEAR") in said


def test_dedup_keeps_first_and_largest_confidence(spark):
    rows = spark.createDataFrame([("b", " Apple", "T", 0.9, "late"), ("a", "apple ", "T", 0.5, "early"), ("c", "apple", "U", 0.1, "other")], "ord string, text string, type string, confidence double, source string")
    assert {(r["ord"], r["confidence"], r["source"]) for r in entities.dedup(rows).collect()} == {("a", 0.9, "early"), ("c", 0.1, "other")}


def test_model_entities(spark):
    c = chunks(spark, "text", "  ")
    assert entities.model_entities(c, None, ["X"]).count() == 0
    found = entities.model_entities(c, lambda prompts: ["ENTITY: A | TYPE: x | CONFIDENCE: 0.5" for _ in prompts], ["X"]).collect()
    assert [(r["chunk_id"], r["text"], r["type"]) for r in found] == [("c0", "A", "X")]


def test_cooccurrence_is_the_sorted_scan(spark):
    text = "Alpha and Beta of Gamma " + "x" * 120 + " Delta with Echo Alpha"
    c = chunks(spark, text, "Solo", None)
    found = entities.keyword_entities(c)
    own = sorted(((r["start"], r["ord"], r["text"], r["end"]) for r in found.where("chunk_id = 'c0'").collect()))
    want = set()
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if b[0] - a[0] <= 100:
                between = text[a[3] : b[0]].strip() if a[3] < b[0] else ""
                score = min(1, 0.5 + max(0, 1 - (b[0] - a[0]) / 100) * 0.3 + 0.1 * sum(w in between.lower() for w in relations.INDICATORS))
                want.add((a[2], b[2], round(score, 6), between))
    assert {(r["source"], r["target"], r["confidence"], r["context"]) for r in relations.cooccurrence(c, found).collect()} == want


def test_patterns(spark):
    c = chunks(spark, "Bob is an apple. She OWNS cars", "Éva is active")
    got = [(r["source"], r["target"], r["type"]) for r in relations.pattern_relations(c).orderBy("ord").collect()]
    want = []
    for t in ("Bob is an apple. She OWNS cars", "Éva is active"):
        for p, kind, _ in relations.PATTERNS:
            want += [(m.group(1), m.group(2), kind) for m in re.finditer(p, t, re.I)]
    assert got == want
    assert relations.pattern_relations(c, [(r"(\w+) is", "X", 1.0)]).count() == 0


def test_generic_relations_link_the_first_column_to_itself(spark):
    rows = spark.createDataFrame([("c", "s", "0", "k", " ", None)], "chunk_id string, source_doc string, ord string, a string, b string, d string")
    assert [(r["target"], r["type"]) for r in relations.table_relations(rows, None).orderBy("ord").collect()] == [("k", "HAS_A"), ("None", "HAS_D")]
    assert [r["type"] for r in relations.table_relations(rows, None, key_column="a").collect()] == ["HAS_D"]


def test_relation_dedup(spark):
    rows = spark.createDataFrame([("1", "A", "b", "T", 0.5), ("2", "a ", "B", "T", 0.9), ("3", "a", "b", "T", 0.9)], "ord string, source string, target string, type string, confidence double")
    assert [r["ord"] for r in relations.dedup(rows).collect()] == ["2"]


def test_factories_refuse_unknown_names():
    for f in (entities.extractor, relations.extractor, chunking.chunker):
        with pytest.raises(ValueError):
            f("nothing")


# the learned text model


def contexts(n=60):
    """Texts about two topics; `auto` and `car` share no text, but their company."""
    rng = np.random.default_rng(1)
    road, sea = "wheel engine road driver tyre fuel".split(), "sail water harbour mast wave anchor".split()
    out = []
    for i in range(n):
        own, name = (road, "car" if i % 4 == 0 else "auto") if i % 2 == 0 else (sea, "boat")
        out.append(" ".join(np.insert(rng.choice(own, 12), [3, 8], name)))
    return out


def test_pairs_are_counted_over_whole_texts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (1, 2, 3, 40, 511, 512, 513, 517, 1500)] + [None, "", "a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    known = text_model.vocabulary(docs, 6, 1)
    ids = {r["word"]: r["id"] for r in known.collect()}
    want = {}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 1 + text_model.WINDOW)):
                if w[i] != w[j] and w[i] in ids and w[j] in ids:
                    key = tuple(sorted((ids[w[i]], ids[w[j]])))
                    want[key] = want.get(key, 0) + 1
    assert len(ids) == 6 and {(r["a"], r["b"]): r["n"] for r in text_model.pairs(docs, known).collect()} == want


def test_learned_words_of_like_company_are_near(spark):
    docs = spark.createDataFrame([(t,) for t in contexts()], "text string")
    model = text_model.fit(docs, dimension=6)
    car, auto, boat, none = model(["car", "auto", "boat", "unseen words"])
    assert car @ auto > 0.8 > 0.5 > car @ boat and not none.any()
    hashed = embedding.hashing_model(["car", "auto"])
    assert hashed[0] @ hashed[1] < 0.5
    # the same vectors from any partitions, up to rounding
    again = text_model.fit(docs.repartition(7), dimension=6)
    assert again.index == model.index and np.abs(again.vectors - model.vectors).max() < 1e-8
    # the decomposition is that of the whole matrix
    entries = text_model.ppmi(text_model.pairs(docs, text_model.vocabulary(docs))).collect()
    m = np.zeros((len(model.index),) * 2)
    for r in entries:
        m[r["a"], r["b"]] = r["x"]
    value = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1]
    assert np.allclose(np.sort((model.vectors**2).sum(0))[::-1][:2], value[:2], rtol=0.02)
    # as a client of the embedder, with columns too
    e = embedding.Embedder("hf", "learned", client=model)
    assert e.dimension == 6 and np.allclose(docs.limit(1).select(e.column(F.col("text")).alias("v")).first()["v"], model([docs.first()["text"]])[0], atol=1e-6)


def test_near_copies_of_documents_are_nearest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200").select("doc_id", "text")
    model = text_model.fit(docs, dimension=32)
    rows = docs.orderBy("doc_id").limit(40).collect()
    changed = [" ".join(w for k, w in enumerate(r["text"].split()) if k % 5) for r in rows]
    own, near = model([r["text"] for r in rows]), model(changed)
    assert np.mean((near @ own.T).argmax(1) == np.arange(len(rows))) > 0.9


def test_model_of_nothing(spark):
    for texts in ([], [(None,)], [("one",)], [("a a a",), ("a",)]):
        model = text_model.fit(spark.createDataFrame(texts, "text string"), dimension=4)
        assert model(["a", None]).shape == (2, 4) and not model(["b"]).any()


def test_keys_without_regular_expressions(spark):
    """What is told by both ends alone is what stripping gives."""
    texts = ["", " ", "A", " a ", "\u00a0B\u2003", "\u3000", "É x", "x É\n", "\x85q", "~!", "\x7f", "\x1fz", "A\tB", "1.5", " 2e3\n", "-.5\u00a0", "1 2", "日本 ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    rows = df.select("t", norm(F.col("t")), strip(F.lower("t")), is_number(F.col("t")), strip(F.col("t")).rlike(pattern)).collect()
    assert len(rows) == len(texts)
    for _, key, whole, number, plain in rows:
        assert key == whole and number == plain


def test_entity_rows_are_made_once(spark):
    """Notes are searched in one step: not in the explode, which would be interpreted then, nor once more in a filter by the array's size."""
    rows = fx.er_rows(spark, "/root/testdata/sf0.001").localCheckpoint()
    plan = entities.row_entities(rows)._jdf.queryExecution().executedPlan().toString()
    searching = [line.lstrip(" +-*()0123456789").split(" ")[0] for line in plan.splitlines() if "regexp_extract_all" in line]
    assert searching == ["Project"]


def test_dedup_sorts_by_the_key_first(spark):
    """Types are few, so a sort by them first compares every row's key as a second text."""
    e = spark.createDataFrame([("A ", "X", 0.5, "1"), ("a", "X", 0.9, "2"), ("a", "Y", 0.1, "3")], "text string, type string, confidence double, ord string")
    out = entities.dedup(e)
    assert sorted(map(tuple, out.collect())) == [("A ", "X", 0.9, "1"), ("a", "Y", 0.1, "3")]
    sorts = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and not any("Sort [type" in line for line in sorts)


def test_keyword_counts_are_keyword_entities_without_places(spark):
    texts = ["Alpha Beta met Gamma. Gamma, Gamma and 7 x@y.org x@y.org", "", "The", "no names", "See https://www.example.com/a 12 12 3.5", "Élan vital É Gamma 12", "Ab " * 70 + "1 " * 300 + "Cd, " * 200, None]
    c = chunks(spark, *texts)
    key = ["chunk_id", "text", "type", "confidence"]
    want = {tuple(r[k] for k in key): r["count"] for r in entities.keyword_entities(c).groupBy(*key).count().collect()}
    got = [(tuple(r[k] for k in key), r["n"]) for r in entities.keyword_counts(c).collect()]
    assert dict(got) == want and len(got) == len(want)
    plan = entities.keyword_counts(c)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_capitalised_runs_of_any_length(spark):
    """No match takes a part of a task's stack for each of its words: an overflow would end the executor."""
    text = "Aa " * 50000
    [[n, size]] = spark.range(1).select(find_spans(F.concat(F.lit(text), F.col("id").cast("string")), CAPITALISED).alias("m")).select(F.size("m"), F.length(F.col("m")[0]["text"])).collect()
    assert (n, size) == (1, len(text) - 1)


def test_pattern_relations_look_for_all_patterns_only_where_words_of_them_are(spark, monkeypatch):
    texts = ["Tom is a cat. Tom has\tmilk", "TOM WAS THE CAT", "İs it\u00a0ıs x, y i\u017f z", "this are", "a\nworks for\nb", "is", " is a", "He built Rome and owns it", "Éva est belle", ""]
    c = chunks(spark, *texts)
    odd = [*relations.PATTERNS, (r"(\w+)\s+(?:is)\s+(\w+)|(cat)", "EITHER", 1.0), (r"(\w+) (\w+)", "BESIDE", 1.0)]
    columns = ["ord", "source", "target", "type", "context"]
    got = [sorted(map(tuple, relations.pattern_relations(c, p).select(columns).collect())) for p in (relations.PATTERNS, odd)]
    assert relations._verbs([p for p, _, _ in relations.PATTERNS]) and relations._verbs([p for p, _, _ in odd]) is None
    monkeypatch.setattr(relations, "_verbs", lambda patterns: None)
    assert got == [sorted(map(tuple, relations.pattern_relations(c, p).select(columns).collect())) for p in (relations.PATTERNS, odd)]
    assert {r[3] for r in got[0]} == {"IS_A", "OWNS", "CREATED", "WORKS_FOR"} and {"EITHER", "BESIDE"} <= {r[3] for r in got[1]}
