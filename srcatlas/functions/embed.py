"""Embedding texts: a protocol, and a deterministic embedder that needs no model."""

from __future__ import annotations

import math
import re
import zlib
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Called once for each batch of texts on an executor.

    ``prefixes`` are what asymmetric models want before a text to be indexed and before a
    query; an embedder without them gets PREFIXES.
    """

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


# What stands before texts that are indexed, and before queries.
PREFIXES = ("search_document: ", "search_query: ")


def for_index(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    return embedder([getattr(embedder, "prefixes", PREFIXES)[0] + t for t in texts])


def for_query(embedder: Embedder, text: str) -> list[float]:
    return embedder([getattr(embedder, "prefixes", PREFIXES)[1] + text])[0]


class HashingEmbedder:
    """Unit vectors of signed word hashes."""

    prefixes = ("", "")

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in re.findall(r"\w+", text.lower()):
                for part in [word, *word.split("_")]:
                    h = zlib.crc32(part.encode())
                    v[h % self.dim] += 1.0 if h & 0x10000 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


def embedding_text(signature: Column, docstring: Column, name: Column) -> Column:
    """What stands for a symbol: signature, docstring and name, a line each."""
    empty = F.lit("")
    return F.trim(F.concat(F.coalesce(signature, empty), F.lit("\n"), F.coalesce(docstring, empty), F.lit("\n"), F.coalesce(name, empty)))


def embed(df: DataFrame, text: Column, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column."""

    @F.arrow_udf("array<float>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(for_index(embedder, [t or "" for t in texts.to_pylist()]), pa.list_(pa.float32()))

    return df.withColumn(name, udf(text))
