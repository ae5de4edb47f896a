"""Texts of nodes and edges, and their embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import left

#: Known models and their dimensions.
PRESETS = {"all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768, "text-embedding-ada-002": 1536, "text-embedding-3-small": 1536}


#: The properties of nodes that their texts hold.
NODE = ("section", "year", "value", "unit")


def node_text() -> Column:
    """TYPE: name, then section, year, value and evidence, where they are."""
    c = F.col
    return F.concat_ws(
        " | ", F.concat("node_type", F.lit(": "), F.coalesce("name", F.lit("Unknown"))), F.concat(F.lit("Section: "), "section"), F.concat(F.lit("Year: "), "year"),
        F.concat(F.lit("Value: "), c("value").cast("string"), F.lit(" "), "unit"), F.concat(F.lit("Evidence: "), left(c("evidence"), 100)),
    )


def edge_text() -> Column:
    """source relation target, then evidence, section and year, where they are."""
    return F.concat_ws(
        " | ", F.concat("source", F.lit(" "), F.lower(F.replace("type", F.lit("_"), F.lit(" "))), F.lit(" "), "target"),
        F.concat(F.lit("Context: "), left(F.col("evidence"), 100)), F.concat(F.lit("in "), "section"), F.concat(F.lit("("), "year", F.lit(")")),
    )


@lru_cache(maxsize=1 << 16)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")


def hashing_model(texts: list[str], dim: int = 384) -> np.ndarray:
    """A model without training: words hashed to signed counts, at length one."""
    words = [re.findall(r"\w+", (text or "").lower()) for text in texts]
    h = np.array([_hashed(w) for own in words for w in own], np.uint64)
    out = np.zeros((len(texts), dim), np.float32)
    np.add.at(out, (np.repeat(np.arange(len(texts)), np.array([len(own) for own in words], np.intp)), (h % np.uint64(dim)).astype(np.intp)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def probe(client: Callable | None, model_name: str) -> int:
    """The dimension that a model's answer to "test" has; without a model, or if it fails, the known one of its name."""
    try:
        return len(np.asarray(client(["test"]))[0]) if client else PRESETS.get(model_name, 384)
    except Exception:  # whatever the model raises: the known dimension stands in
        return PRESETS.get(model_name, 384)


class Embedder:
    """embed_documents and embed_query over one model, for lists and for columns (in Arrow batches).

    model: a callable from a list of texts to an array of rows; a loader is called once in each worker.
    """

    def __init__(self, backend: str = "hashing", model_name: str = "all-MiniLM-L6-v2", dimension: int | None = None, client: Callable | None = None):
        if backend not in ("hashing", "hf", "openai"):
            raise ValueError(f"unknown embedding backend {backend!r}")
        if backend != "hashing" and client is None:
            raise ValueError(f"the {backend} backend needs a client")
        self.backend, self.model_name = backend, model_name
        self.dimension = dimension or probe(client, model_name)
        self.model = client or partial(hashing_model, dim=self.dimension)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return np.asarray(self.model(texts)).tolist() if texts else []

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]

    def column(self, text: Column) -> Column:
        model = self.model

        @F.pandas_udf("array<float>")
        def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series(list(np.asarray(model(part.fillna("").tolist()), np.float32)), index=part.index)

        return embed(text)

    def info(self) -> dict:
        return {"backend": self.backend, "model_name": self.model_name, "dimension": self.dimension}


def embed_nodes(nodes: DataFrame, embedder: Embedder) -> DataFrame:
    return nodes.withColumn("text", node_text()).withColumn("embedding", embedder.column(F.col("text")))


def embed_edges(edges: DataFrame, embedder: Embedder) -> DataFrame:
    named = edges.withColumn("edge_id", F.concat_ws("_", "source", "type", "target"))
    return named.withColumn("text", edge_text()).withColumn("embedding", embedder.column(F.col("text")))


def embedding_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("total_node_embeddings"), F.max(F.size("embedding")).alias("embedding_dimension"))
    return n.join(edges.agg(F.count("*").alias("total_edge_embeddings")), how="cross")
