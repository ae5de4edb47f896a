"""What a question asks: intent, entities, keywords, time markers and filters, as columns over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import find_all
from skeinwork.operators.entities import CAPITALISED

#: Patterns and words of the specification, in its order.
INTENTS = (
    ("entity_lookup", (r"\bwhat is\b", r"\bwho is\b", r"\bdefine\b", r"\bexplain\b")),
    ("relationship", (r"\bhow.*related\b", r"\brelationship between\b", r"\bconnection between\b", r"\blink between\b")),
    ("aggregation", (r"\btotal\b", r"\bsum\b", r"\bcount\b", r"\baverage\b", r"\bhow many\b", r"\bhow much\b")),
    ("temporal", (r"\bin \d{4}\b", r"\bduring\b", r"\bwhen\b", r"\btimeline\b")),
    ("comparison", (r"\bcompare\b", r"\bversus\b", r"\bvs\b", r"\bdifference between\b")),
)
INDICATORS = (
    ("ORGANIZATION", ("company", "corporation", "firm", "business")),
    ("PRODUCT", ("product", "brand", "line")),
    ("METRIC", ("revenue", "profit", "sales", "growth", "performance")),
)
STOP_WORDS = "the is at which on a an and or but in with to for of as by from".split()
YEAR = r"(?U)\b(20\d{2})\b"
RELATIVE = r"\b(last year|this year|previous year|recent|latest)\b"
ROUTES = {"entity_lookup": "graph", "relationship": "graph", "exploration": "hybrid", "factual": "hybrid"}


def intent(q: Column) -> Column:
    out = None
    for name, patterns in INTENTS:
        hit = F.lower(q).rlike("(?U)" + "|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("exploration")


def entities(q: Column) -> Column:
    return F.array_distinct(F.concat(find_all(q, CAPITALISED), find_all(q, '"([^"]*)"', 1), find_all(q, YEAR, 1)))


def keywords(q: Column) -> Column:
    return F.filter(find_all(F.lower(q), r"(?U)\b\w+\b"), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2))


def temporal(q: Column) -> Column:
    return F.concat(find_all(q, YEAR, 1), find_all(F.lower(q), RELATIVE, 1))


def node_type(q: Column) -> Column:
    """The last type one of whose words is anywhere in the question."""
    out = None
    for name, words in reversed(INDICATORS):  # a chain of conditions takes the first that holds
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(q).contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def route(intent: Column) -> Column:
    """The strategy that an intent is answered by."""
    out = None
    for name, strategy in ROUTES.items():
        out = F.when(intent == name, strategy) if out is None else out.when(intent == name, strategy)
    return out.otherwise("vector")


def process(questions: DataFrame, embedder=None) -> DataFrame:
    """questions (query_id, question) with all of the above."""
    q = F.col("question")
    out = questions.select("*", intent(q).alias("intent"), entities(q).alias("entities"), keywords(q).alias("keywords"), temporal(q).alias("temporal"), node_type(q).alias("node_type_filter"))
    out = out.withColumn("route", route(F.col("intent")))
    return out.withColumn("query", embedder.column(q)) if embedder else out


def validate(parsed: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """query_id, entity, exists: whether each named entity is a node; without a graph all are."""
    named = parsed.select("query_id", F.explode("entities").alias("entity"))
    if nodes is None:
        return named.withColumn("exists", F.lit(True))
    known = nodes.select(F.col("name").alias("entity"), F.lit(True).alias("known")).distinct()
    return named.join(known, "entity", "left").select("query_id", "entity", F.coalesce("known", F.lit(False)).alias("exists"))


def parse_command(line: str, strategy: str = "adaptive", k: int = 10) -> dict:
    """An interactive line: exit, help, or [cite] [retrieve] [strategy:<name>] question, in that order."""
    from skeinwork.config import STRATEGIES

    text = line.strip()
    if text.lower() in ("exit", "quit", "help"):
        return {"command": "help" if text.lower() == "help" else "exit"}
    out = {"command": "answer", "cite": False, "strategy": strategy, "k": k}
    if text.lower().startswith("cite "):
        out["cite"], text = True, text[5:].strip()
    if text.lower().startswith("retrieve "):
        out["command"], text = "retrieve", text[9:].strip()
    if text.lower().startswith("strategy:"):
        name, _, text = text[9:].partition(" ")
        if name.lower() not in STRATEGIES:
            raise ValueError(f"unknown strategy {name!r}")
        out["strategy"] = name.lower()
    return out | {"question": text.strip()}
