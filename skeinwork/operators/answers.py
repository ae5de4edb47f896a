"""Prompts, answers by an injected model, and how far to trust them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RULE = "=" * 80
_GROUND = (
    "Answer the question from the knowledge-graph context below and from nothing else.\n"
    "Say what is missing if the context is not enough. Name the entities, relationships and values that you rely on,\n"
    "say how certain you are, and be brief."
)
_CITE = "Answer the question with citations: [Entity: name] for entities, [Source: section] for sections, numbered [1], [2], with a list of references at the end."


#: What stands before the context, between it and the question, and behind that: with the sources asked for, without, and with citations.
PLAIN = (f"{_GROUND}\n\n{_RULE}\nCONTEXT\n{_RULE}\n", f"\n\n{_RULE}\nQUESTION\n{_RULE}\n", f"\n\n{_RULE}\nANSWER\n{_RULE}\n")
SOURCED = (PLAIN[0].replace(_GROUND, f"{_GROUND}\nName the sources of facts."), *PLAIN[1:])
CITED = (f"{_CITE}\n\nCONTEXT:\n", "\n\nQUESTION:\n", "\n\nANSWER WITH CITATIONS:\n")


def _filled(parts: tuple[str, str, str]) -> Column:
    return F.concat(F.lit(parts[0]), "context_text", F.lit(parts[1]), "question", F.lit(parts[2]))


def prompt(with_sources: bool = True) -> Column:
    return _filled(SOURCED if with_sources else PLAIN)


def citation_prompt() -> Column:
    return _filled(CITED)


def confidence() -> Column:
    """0.5, and 0.2 or 0.1 for more than 5 or 2 entities, and the same for relationships, at most 0.95."""
    step = lambda n: F.when(F.col(n) > 5, 0.2).when(F.col(n) > 2, 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(0.5) + step("entity_count") + step("relationship_count"), F.lit(0.95)), 6)


def generate(contexts: DataFrame, client=None, citations: bool = False, with_sources: bool = True) -> DataFrame:
    """query_id, answer, sources, confidence. client: a callable from one prompt to an answer; None gives empty answers. An error is the
    answer, with confidence 0 and no sources."""
    asked = contexts.select("query_id", "sources", confidence().alias("confidence"), (citation_prompt() if citations else prompt(with_sources)).alias("prompt"))

    def run(batches):
        for b in batches:
            answers, failed = [], []
            for text in b.column(3).to_pylist():
                try:
                    answers.append("" if client is None else client(text))
                    failed.append(False)
                except Exception as e:  # whatever the model raises is the answer
                    answers.append(f"Error{'' if citations else ' generating answer'}: {e}")
                    failed.append(True)
            shown = [[] if f or not (citations or with_sources) else s for f, s in zip(failed, b.column(1).to_pylist())]
            sure = [0.0 if f else c for f, c in zip(failed, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(shown, pa.list_(pa.string())), pa.array(sure, pa.float64())], names=["query_id", "answer", "sources", "confidence"])

    return asked.mapInArrow(run, "query_id string, answer string, sources array<string>, confidence double")
