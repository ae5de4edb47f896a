"""The jobs over growing input and over odd rows, rerun, and held against plain counts."""

import json
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import build_graph, question_log
from jobs.common import settings

FOLDER = "/root/testdata/sf0.001"
TURNS = question_log.SCHEMA


def rows(df):
    return sorted((tuple(map(repr, r)) for r in df.collect()))


# the graph

ODD = [
    (1, "Alpha Beta met Gamma. Gamma is a tool. It was built in 2021. Ask x@y.org today."), (1, "Alpha Beta met Gamma. Gamma is a tool. It was built in 2021. Ask x@y.org today."),
    (1, "Another text of Alpha Beta. One more."), (2, None), (3, ""), (4, " \n\t "), (None, "Delta is the river. See https://www.example.com/a for 12 more."), (5, "Élan vital. Éclair is a cake! Épée?"), (6, "no end"),
]


def by_hand(docs, in_chunk=3, step=2):
    """({entity: (chunks, docs)}, {(chunk text, entity): n}) by plain regular expressions."""
    marks = [(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "NAMED_ENTITY"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"), (r"https?://\S+", "URL"), (r"\b\d+(?:\.\d+)?\b", "NUMBER")]
    edges, of = {}, {}
    for doc, text in dict.fromkeys(docs):
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "") if x.strip()]
        for k in range(0, len(s), step):
            chunk = " ".join(s[k : k + in_chunk])
            for pattern, kind in marks:
                for hit in re.findall(pattern, chunk):
                    if kind != "NAMED_ENTITY" or (2 <= len(hit) <= 50 and hit.lower() not in build_graph.entities.STOP_WORDS):
                        edges[(doc, k, chunk, hit, kind)] = edges.get((doc, k, chunk, hit, kind), 0) + 1
    for doc, k, chunk, hit, kind in edges:
        of.setdefault((hit, kind), set()).add((doc, k, chunk))
    return {e: (len(c), len({d for d, _, _ in c})) for e, c in of.items()}, edges


def test_graph_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(a, b, "x", 1.5, "y") for a, b in ODD], "doc_id long, text string, chunk_id string, ord double, node_type string")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    out = build_graph.run(spark, f"{tmp_path}/docs", f"{tmp_path}/graph")
    first = rows(out)
    entities, edges = by_hand(ODD)
    found = out.where("part = 'node' and type <> 'CHUNK'").collect()
    assert {(r["source"], r["type"]): (r["n"], r["n_docs"]) for r in found} == entities and len(found) == len(entities)
    chunk = {r["source"]: r["text"] for r in out.where("type = 'CHUNK'").collect()}
    met = {}
    for r in out.where("type = 'MENTIONS'").collect():
        doc, at = r["source"].split("#")[:2]
        met[(None if "null" in doc else int(doc), 2 * int(at), chunk[r["source"]], r["target"])] = r["n"]
    assert met == {k[:4]: n for k, n in edges.items()}
    said = {(r["source"], r["target"], r["type"]) for r in out.where("part = 'edge' and type <> 'MENTIONS'").collect()}
    assert {("Gamma", "tool", "IS_A"), ("Delta", "river", "IS_A"), ("Éclair", "cake", "IS_A")} <= said
    counts = {(r["kind"], r["type"]): r["n"] for r in spark.read.json(f"{tmp_path}/graph/statistics").collect()}
    assert counts[("nodes", "CHUNK")] == len(chunk) and counts[("edges", "MENTIONS")] == len(edges)
    # again, from other files in another order: the same graph
    docs.orderBy(F.desc("text")).coalesce(1).write.parquet(f"{tmp_path}/other")
    assert rows(build_graph.run(spark, f"{tmp_path}/other", f"{tmp_path}/graph")) == first


def test_graph_settings_and_empty_input(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = build_graph.run(spark, f"{tmp_path}/docs", f"{tmp_path}/graph", {"sentences_in_chunk": 1, "sentences_shared": 0, "min_chunks": 2})
    assert {r["source"] for r in out.where("part = 'node' and type <> 'CHUNK'").collect()} == {"Alpha Beta", "Gamma"} == {r["target"] for r in out.where("type = 'MENTIONS'").collect()}
    spark.createDataFrame(ODD, "doc_id long, text string").limit(0).write.parquet(f"{tmp_path}/none")
    assert build_graph.run(spark, f"{tmp_path}/none", f"{tmp_path}/graph").count() == 0


def test_a_long_run_of_capitalised_words(spark, tmp_path):
    """A title of any length takes no more of a task's stack than a short one."""
    docs = [(1, "Aa " * 40000 + "ends. Beta Gamma"), (2, "Alpha Beta is a tool.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = build_graph.run(spark, f"{tmp_path}/docs", f"{tmp_path}/graph").collect()
    assert {r["source"]: r["n"] for r in out if r["part"] == "node" and r["type"] != "CHUNK"} == {"Alpha Beta": 1, "Beta Gamma": 1}
    assert max(len(r["text"] or "") for r in out) == 40000 * 3 + len("ends. Beta Gamma")


def test_only_documents_whose_id_comes_again_are_shuffled(spark):
    """Chunks are each there once, and texts of ids that come once stay where they are read."""
    def exchanges(docs):
        return build_graph.chunks_of(docs, 3, 1)._jdf.queryExecution().executedPlan().toString().count("Exchange")

    schema = "doc_id long, text string"
    once = spark.createDataFrame([(i, f"Text {i}. It is a text.") for i in range(9)], schema)
    assert exchanges(once) == 0 < exchanges(spark.createDataFrame(ODD, schema))
    of_odd = build_graph.chunks_of(spark.createDataFrame(ODD + [(9, t) for _, t in ODD], schema), 1, 0).collect()
    cut_up = {(d, t) for d, t in ODD + [(9, t) for _, t in ODD] if t and t.strip()}
    sentences = {(d, k, s) for d, t in cut_up for k, s in enumerate(re.split(r"(?<=[.!?])\s+", t.strip()))}
    assert len(of_odd) == len({r["chunk_id"] for r in of_odd}) == len(sentences)
    assert {(r["chunk_id"][:20].lstrip("0"), r["text"]) for r in of_odd} == {("null" if d is None else str(d), s) for d, _, s in sentences}
    assert build_graph.chunks_of(once, 3, 1).count() == 9


# the log of questions


def test_log_over_growing_input(spark, tmp_path):
    every = spark.read.parquet(f"{FOLDER}/conversations.parquet").cache()
    where, log, state = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/state"
    every.where("conv_id % 2 = 0").write.parquet(where)
    first = question_log.run(spark, where, log, state)
    n = first.count()
    assert n == every.where("conv_id % 2 = 0 and role = 'user' and text is not null").distinct().count() > 0
    # nothing new: nothing changes
    assert rows(question_log.run(spark, where, log, state)) == rows(first)
    # new files, some of whose turns were there before
    every.where("conv_id % 2 = 1 or conv_id % 6 = 0").repartition(3).write.mode("append").parquet(where)
    second = question_log.run(spark, where, log, state)
    once = question_log.parsed(every.where("role = 'user' and text is not null").distinct())
    assert rows(second.select(once.columns)) == rows(once)
    assert {r["batch"] for r in second.collect()} == {0, 1} and rows(second.where("batch = 0")) == rows(first)
    # counts of batches add up to what the whole log has
    whole = second.groupBy("route", "intent", "node_type_filter").agg(F.count("*").alias("n_questions"))
    assert rows(question_log.totals(spark, log).select(whole.columns)) == rows(whole)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    where, log, state = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/state"
    spark.read.parquet(f"{FOLDER}/conversations.parquet").repartition(4).write.parquet(where)
    first = rows(question_log.run(spark, where, log, f"{state}-1", {"files_in_batch": 2}))
    # the same input with a lost checkpoint: the same batches are written over
    assert rows(question_log.run(spark, where, log, f"{state}-2", {"files_in_batch": 2})) == first
    assert spark.read.parquet(f"{log}/questions").select("batch").distinct().count() == 2


def test_odd_turns(spark, tmp_path):
    odd = [(1, 0, "user", None), (1, 1, "user", ""), (1, 2, "user", 'What is "Élan" in 2023?'), (1, 2, "user", 'What is "Élan" in 2023?'), (1, 2, "user", "How are A and Beta related?"), (None, None, "user", "Compare Brand Sales"), (2, 0, "assistant", "No question"), (2, 1, None, "x"), (3, 0, "user", "w " * 50000)]
    spark.createDataFrame(odd, TURNS).write.parquet(f"{tmp_path}/in")
    out = {(r["conv_id"], r["turn"], r["question"]): r for r in question_log.run(spark, f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/state").collect()}
    assert len(out) == 5 and out[(1, 1, "")]["route"] == "hybrid" and out[(None, None, "Compare Brand Sales")]["node_type_filter"] == "METRIC"
    asked = out[(1, 2, 'What is "Élan" in 2023?')]
    assert asked["entities"] == ["What", "Élan", "2023"] and asked["temporal"] == ["2023"] and (asked["intent"], asked["route"]) == ("entity_lookup", "graph")
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/none")
    assert question_log.run(spark, f"{tmp_path}/none", f"{tmp_path}/log2", f"{tmp_path}/state2").count() == 0
    assert question_log.totals(spark, f"{tmp_path}/log2").count() == 0


def test_the_log_knows_the_graph_that_the_other_job_built(spark, tmp_path):
    docs = [(1, "Alpha Beta met Gamma in 2021."), (2, "Gamma and Delta. Delta alone.")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    build_graph.run(spark, f"{tmp_path}/docs", f"{tmp_path}/graph")
    asked = [(1, 0, "user", "Who met Gamma? Gamma and Omega, in 2021"), (1, 1, "user", "no names"), (2, 0, "user", "is Alpha Beta older than Gamma?"), (3, 0, "user", "Who met Gamma? Gamma and Omega, in 2021")]
    spark.createDataFrame(asked, TURNS).write.parquet(f"{tmp_path}/in")
    out = question_log.run(spark, f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/state", {"graph": f"{tmp_path}/graph"}).collect()
    assert {(r["conv_id"], r["turn"]): r["known"] for r in out} == {(1, 0): ["2021", "Gamma"], (1, 1): [], (2, 0): ["Alpha Beta", "Gamma"], (3, 0): ["2021", "Gamma"]}
    # without a graph nothing is said of it
    out = question_log.run(spark, f"{tmp_path}/in", f"{tmp_path}/log2", f"{tmp_path}/state2")
    assert [r["known"] for r in out.collect()] == [None] * 4


def test_settings_are_put_back(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(RuntimeError), settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.skein.unset": "1"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.skein.unset", None) is None


def test_jobs_use_nothing_of_the_training_data_operators():
    code = "import sys, jobs.queries; print([m for m in sys.modules if m.startswith(('skeinwork.llm', 'corpus_pipeline'))])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "[]"


def test_config_files():
    for job in (build_graph, question_log):
        with open(f"{job.__file__[:-3]}.json") as f:
            assert json.load(f) == job.CONFIG


def test_chunks_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Texts of chunks are written by the tasks that have them; only nodes of entities are dealt out anew."""
    kind, dealt = type(spark.range(1)), []
    hint = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, *a: dealt.append(self) or hint(self, *a))
    build_graph.run(spark, "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "graph"))
    nodes = [df for df in dealt if "node_id" in df.columns]
    assert nodes and not any("CHUNK" in df._jdf.queryExecution().analyzed().toString() for df in nodes)
