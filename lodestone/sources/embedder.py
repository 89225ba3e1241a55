"""Embedders: what turns texts into vectors, injected into the backfill; a deterministic one and one behind HTTP."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before a text by its use.
DOCUMENT, QUERY = "search_document: ", "search_query: "


class Embedder(Protocol):
    """A space's identity and length, a check that it answers, and the vectors of texts."""

    profile: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def probe(e: Embedder) -> None:
    """Whether the embedder answers with finite vectors of its length."""
    for v in e.embed([DOCUMENT + "probe"]):
        if len(v) != e.dimensions or not all(map(math.isfinite, v)):
            raise ValueError("the embedder's vectors have another length or aren't finite")


@dataclass(frozen=True)
class HashEmbedder:
    """Vectors from the text's digest: for tests, the same everywhere."""

    profile: str = "hash"
    dimensions: int = 8

    def embed(self, texts: list[str]) -> list[list[float]]:
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[d[i % 32] / 127.5 - 1 for i in range(self.dimensions)] for d in digests]


@dataclass(frozen=True)
class HttpEmbedder:
    """Posts {"input": [texts]} and reads {"data": [{"embedding": [...]}]} in the order of the texts."""

    url: str
    profile: str
    dimensions: int
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(self.url, json.dumps({"input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            out = [row["embedding"] for row in json.load(reply)["data"]]
        if len(out) != len(texts):
            raise ValueError("the server left texts out")
        return out


def embedding(e: Embedder, prefix: str = DOCUMENT, batch: int = 64):
    """An Arrow-batched expression text -> struct(vector, failure): a text whose call fails alone is a failure, not the job's end."""

    @F.pandas_udf(T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("failure", T.StringType())]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(texts: list[str]) -> list[tuple]:
            try:
                return [(v, None) for v in e.embed([prefix + t for t in texts])]
            except Exception:
                if len(texts) == 1:
                    return [(None, "input-too-large")]
                return [x for t in texts for x in one([t])]

        for s in batches:
            rows = [x for i in range(0, len(s), batch) for x in one(s.iloc[i : i + batch].fillna("").tolist())]
            yield pd.DataFrame(rows, columns=["vector", "failure"])

    return run


def query_vector(e: Embedder, text: str) -> list[float]:
    return e.embed([QUERY + text])[0]
