"""Segmentation of texts and rows into chunks. Every function takes (and keeps) `doc_id` and `text`."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import bare, strip

_SPANS = "array<struct<chunk_index:int,text:string,start_char:int,end_char:int,chunk_type:string>>"


def _fixed(text: str, size: int, overlap: int, kind: str = "fixed_size") -> list[tuple]:
    out: list[tuple] = []
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            stop = max(text.rfind(mark, start, end) for mark in ".?!")
            space = text.rfind(" ", start, end)
            if stop > start:
                end = stop + 1
            elif space > start:
                end = space
        body = text[start:end].strip()
        if body:
            out.append((len(out), body, start, end, kind))
        if end >= n:
            break
        # a window that ends within the overlap would begin again where it began, or before
        start = end - overlap if end - overlap > start else end
    return out


def fixed_size(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of `size` characters that end after a sentence mark, else at a space, else hard; the next begins `overlap` before."""
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")

    @F.pandas_udf(_SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: _fixed(t or "", size, overlap))

    return _inline(docs, spans("text"))


def _paragraphs(text: str, most: int) -> list[tuple]:
    import re

    parts = [p.strip() for p in re.split(r"\n\n+", text)]
    parts = [p for p in parts if p]
    if not parts:
        return []
    out: list[tuple] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            out.append((len(out), "\n\n".join(held), None, None, "semantic"))
            held.clear()
        size = 0

    for p in parts:
        if size + len(p) > most:
            flush()
        if len(p) > most:
            # its windows count from 0 again
            out.extend((i, t, a, b, "semantic_split") for i, t, a, b, _ in _fixed(p, most, 50))
        else:
            held.append(p)
            size += len(p)
    flush()
    return out


def semantic(docs: DataFrame, max_size: int = 1000, min_size: int = 100) -> DataFrame:
    """Paragraphs joined while they fit; a longer one is cut by fixed_size(max_size, 50). min_size is taken and, as specified, without effect."""

    @F.pandas_udf(_SPANS)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: _paragraphs(t or "", max_size))

    return _inline(docs, spans("text"))


def _inline(docs: DataFrame, spans: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(spans).alias("c")).select("doc_id", "c.*")


def sentences(docs: DataFrame, per_chunk: int = 3, overlap: int = 1) -> DataFrame:
    """Runs of `per_chunk` sentences that share `overlap` with the run before; sentences end at . ! ? before white space."""
    if overlap >= per_chunk:
        raise ValueError("overlap must be smaller than the number of sentences in a chunk")
    parts = F.filter(F.transform(F.split("text", r"(?U)(?<=[.!?])\s+", -1), lambda x: F.when(bare(x), x).otherwise(strip(x))), lambda x: x != "")
    with_parts = docs.select("doc_id", parts.alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(per_chunk - overlap))
    each = with_parts.select("doc_id", "s", F.posexplode(starts).alias("chunk_index", "sentence_start"))
    end = F.least(F.col("sentence_start") + per_chunk, F.size("s"))
    return each.select(
        "doc_id", "chunk_index", F.array_join(F.slice("s", F.col("sentence_start") + 1, F.lit(per_chunk)), " ").alias("text"),
        "sentence_start", end.alias("sentence_end"), F.lit("sentence").alias("chunk_type"),
    )


def csv_rows(rows: DataFrame, columns: list[str], key: str, rendering: str = "key_value") -> DataFrame:
    """One chunk a row: "k: v, k: v", a JSON object, or "The k is v." sentences. A missing value reads None (null in JSON)."""
    values = {c: F.col(c).cast("string") for c in columns}
    shown = {c: F.coalesce(v, F.lit("None")) for c, v in values.items()}
    if rendering == "key_value":
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), v) for c, v in shown.items()])
    elif rendering == "sentence":
        text = F.concat_ws(" ", *[F.concat(F.lit(f"The {c} is "), v, F.lit(".")) for c, v in shown.items()])
    elif rendering == "json":

        @F.pandas_udf("string")
        def dump(frame: pd.DataFrame) -> pd.Series:
            return pd.Series([json.dumps(dict(zip(frame.columns, row)), ensure_ascii=False) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)])

        text = dump(F.struct(*[v.alias(c) for c, v in values.items()]))
    else:
        raise ValueError(f"unknown rendering {rendering!r}")
    data = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*values.values()))
    return rows.select(F.concat(F.lit("row_"), F.col(key).cast("string")).alias("chunk_id"), F.col(key).alias("row_index"), text.alias("text"), F.lit("csv_row").alias("chunk_type"), F.array(*map(F.lit, columns)).alias("columns"), data.alias("row_data"))


_STRATEGIES = {"fixed": fixed_size, "sentence": sentences, "semantic": semantic, "csv_row": csv_rows}


def chunker(strategy: str):
    """The function of a strategy."""
    if strategy not in _STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known: {', '.join(_STRATEGIES)}")
    return _STRATEGIES[strategy]


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")
