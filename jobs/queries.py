"""The jobs as queries: each runs twice into one new folder of the shared one and returns the output as it stands then; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_graph, question_log
from skeinwork.functions.storage import shared_dir
from skeinwork.plans.oracles import job_graph_sql, job_questions_sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job1")
    for _ in range(2):
        out = build_graph.run(spark, f"{sf_dir}/documents.parquet", folder)
    return out


def job2_question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "job2")
    for _ in range(2):
        out = question_log.run(spark, f"{sf_dir}/conversations.parquet", f"{folder}/log", f"{folder}/checkpoint")
    lists = {c: F.array_join(c, "|") for c in ("entities", "keywords", "temporal")}
    return out.withColumns(lists).drop("batch", "known")  # no graph is given


QUERIES = {f.__name__: f for f in (job1_build_graph, job2_question_log)}
ORACLES = {"job1_build_graph": job_graph_sql(), "job2_question_log": job_questions_sql()}
