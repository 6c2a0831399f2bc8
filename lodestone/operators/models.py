"""Pluggable embedders and rerankers, with deterministic stand-ins, and model profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens
from lodestone.operators.fts import plain_tokens

QUERY_PREFIX = "Represent this search query for retrieval: "
Embedder = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Profile:
    """What a model needs: vector size, longest input, weight of keyword hits, chunk budget."""

    name: str
    dimensions: int
    max_tokens: int = 512
    keyword_weight: float = 1.0
    chunk_budget: int = 50_000
    scope_prefix: bool = False
    model: str = ""


# Name, model, dimensions, longest input, whether the scope prefix helps, weight of keyword hits.
KNOWN = [
    ("bge-small", "BAAI/bge-small-en-v1.5", 384, 512, False, 1.0),
    ("bge-base", "BAAI/bge-base-en-v1.5", 768, 512, True, 1.0),
    ("gte-base", "thenlper/gte-base", 768, 512, False, 1.0),
    ("arctic-xs", "Snowflake/snowflake-arctic-embed-xs", 384, 512, False, 1.0),
    ("nomic-v1.5", "nomic-ai/nomic-embed-text-v1.5", 768, 8192, True, 1.0),
    ("jina-code", "jinaai/jina-embeddings-v2-base-code", 768, 8192, True, 1.0),
    ("coderank", "nomic-ai/CodeRankEmbed", 768, 8192, True, 1.0),
    ("nomic-http", "nomic-embed", 768, 8192, True, 0.0),
    ("qwen3-http", "qwen3-embed", 1024, 8192, True, 1.0),
    ("nomic-code-http", "nomic-embed-code", 3584, 8192, True, 0.0),
    ("coderank-http", "code-rank-embed", 768, 8192, True, 0.0),
]
PRESETS = {"default": "bge-small"}
PROFILES = {"hashed": Profile("hashed", 64)} | {n: Profile(n, d, t, w, scope_prefix=p, model=m) for n, m, d, t, p, w in KNOWN}


def register_profile(profile: Profile) -> None:
    PROFILES[profile.name] = profile


def resolve_profile(model: str | None = None, preset: str | None = None) -> Profile | None:
    """A profile by its name or its model's, else by a preset, else none; an unknown model has none."""
    if model:
        return PROFILES.get(model) or next((p for p in PROFILES.values() if p.model == model), None)
    return PROFILES.get(PRESETS.get(preset or "", ""))


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """Signed feature hashing of words: deterministic, without a model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in plain_tokens(t or ""):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
        return out

    return embed


def embed(df: DataFrame, text_col: str, make: Callable[[], Embedder], name: str = "embedding") -> DataFrame:
    """Add vectors batch by batch; ``make()`` loads the model once in each task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())))

    return df.withColumn(name, vectors(F.col(text_col)))


def embed_query(query: str, embedder: Embedder) -> list[float]:
    return embedder([QUERY_PREFIX + query])[0].tolist()


def lexical_rerank(results: DataFrame, query: str, text_col: str, top_k: int) -> DataFrame:
    """The share of query words that a text holds, all JVM-side; equal shares keep their rank."""
    words = sorted(set(plain_tokens(query)))
    q = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    share = F.size(F.array_intersect(q, tokens(F.col(text_col)))) / F.lit(max(1, len(words)))
    return results.withColumn("rerank_score", share).orderBy(F.desc("rerank_score"), "rank").limit(top_k)


def model_rerank(results: DataFrame, query: str, text_col: str, make: Callable[[], Callable[[str, list[str]], list[float]]], top_k: int) -> DataFrame:
    """A cross-encoder's scores, batch by batch. If the model fails on any batch, all rows keep their order, with score 0.

    The results are a limited list, so one task scores them and a failure is known to it as a whole.
    """

    @F.pandas_udf(T.DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = list(batches)
        try:
            model = make()
            yield from [pd.Series(model(query, batch.fillna("").tolist()), dtype="float64") for batch in held]
        except (OSError, ValueError, RuntimeError):
            yield from [pd.Series([0.0] * len(batch)) for batch in held]

    return results.coalesce(1).withColumn("rerank_score", scores(F.col(text_col))).orderBy(F.desc("rerank_score"), "rank").limit(top_k)
