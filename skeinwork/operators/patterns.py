"""Patterns over a stored graph: nodes with types and values, edges between them, runs of several edges; each match is a row.

A pattern is given as values, not as text: there is nothing to parse, and what is asked for is compared as it is (a name that holds quotes or
code is a name). Types and values filter nodes and edges before they are joined; the order of the joins follows the pattern from its
most selective node on, each by the node that is known already, so no two sides are ever paired without a key.

As in other graph languages an edge stands for one edge of a pattern at most in a match; nodes may come again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a run, at most: each is a join.
MOST = 10


@dataclass(frozen=True)
class Node:
    """name: what the match calls it; kind: a node type, or several; having: columns and the values they must have."""

    name: str
    kind: str | Sequence[str] | None = None
    having: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    """From the node that the pattern calls source to target. kind: an edge type, or several; either: in both directions; least and most: how many edges
    in a row stand for it (all of that kind and direction); name: what the match calls them, the list of their edge_ids."""

    source: str
    target: str
    kind: str | Sequence[str] | None = None
    name: str | None = None
    either: bool = False
    least: int = 1
    most: int = 1


def _of_kind(df: DataFrame, column: str, kind: str | Sequence[str] | None) -> DataFrame:
    return df if kind is None else df.where(F.col(column).isin([kind] if isinstance(kind, str) else list(kind)))


def _steps(edges: DataFrame, edge: Edge, back: bool) -> DataFrame:
    """a, b, id: what one edge of a run leads to."""
    own = _of_kind(edges, "type", edge.kind)
    there = own.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_id").alias("id"))
    here = own.select(F.col("target").alias("a"), F.col("source").alias("b"), F.col("edge_id").alias("id"))
    if edge.either:
        return there.union(here.where("a <> b"))
    return here if back else there


def match(nodes: DataFrame, edges: DataFrame, of: Sequence[Node], by: Sequence[Edge]) -> DataFrame:
    """A row for each match: the node's row as a struct under each node's name, and under each edge's name its edge_ids. nodes: node_id, node_type and
    more; edges: source, target, type, edge_id. Every node of the pattern must be an end of one of its edges, or be its only node."""
    named = {n.name: n for n in of}
    loose = {e for edge in by for e in (edge.source, edge.target)} ^ set(named)
    if len(named) != len(of) or (loose and not (len(of) == 1 and not by)) or any(not 0 < e.least <= e.most <= MOST for e in by):
        raise ValueError("each node of a pattern needs a name of its own and an edge, each edge two nodes and 1 to 10 edges")

    def rows(name: str) -> DataFrame:
        n = named[name]
        own = _of_kind(nodes, "node_type", n.kind)
        for column, value in n.having.items():
            own = own.where(F.col(column).eqNullSafe(F.lit(value)))
        return own.select(F.col("node_id").alias("key"), F.struct("*").alias("row"))

    # values tell most, then types
    first = max(of, key=lambda n: (len(n.having), n.kind is not None))
    found = rows(first.name).select(F.struct(F.col("key").alias(first.name)).alias("keys"), F.struct(F.col("row").alias(first.name)).alias("rows"), F.array().cast("array<string>").alias("used"), F.struct(F.lit(0).alias("none")).alias("runs"))
    known, left = {first.name}, list(by)
    while left:
        edge = next((e for e in left if e.source in known or e.target in known), None)
        if edge is None:
            raise ValueError("a pattern must hang together")
        left.remove(edge)
        back = edge.source not in known
        start, end = (edge.target, edge.source) if back else (edge.source, edge.target)
        step = _steps(edges, edge, back)
        at = found.withColumns({"at": F.col("keys").getField(start), "run": F.array().cast("array<string>")})
        out = None
        for n in range(1, edge.most + 1):
            met = at.join(step, at["at"] == step["a"]).where(~F.array_contains("used", F.col("id")))
            ids = F.array_append("run", F.col("id")) if not back else F.array_prepend("run", F.col("id"))
            at = met.select("keys", "rows", F.array_append("used", F.col("id")).alias("used"), "runs", F.col("b").alias("at"), ids.alias("run"))
            if n >= edge.least:
                out = at if out is None else out.union(at)
        if end in known:
            out = out.where(F.col("keys").getField(end) == F.col("at"))
        else:
            other = rows(end)
            out = out.join(other, out["at"] == other["key"]).withColumns({"keys": F.col("keys").withField(end, F.col("at")), "rows": F.col("rows").withField(end, F.col("row"))})
            known.add(end)
        if edge.name:
            out = out.withColumn("runs", F.col("runs").withField(edge.name, F.col("run")))
        found = out.select("keys", "rows", "used", "runs")
    return found.select(*[F.col("rows").getField(n.name).alias(n.name) for n in of], *[F.col("runs").getField(e.name).alias(e.name) for e in by if e.name])
