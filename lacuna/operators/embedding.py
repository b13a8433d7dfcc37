"""Embedding through providers: cache first, then the service with retries; failures stay with their row."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import config
from lacuna.sources import cache as cache_tables

ANSWER = "sample_id string, embedding array<double>, embedding_error string"


class Provider(Protocol):
    """What an embedding service offers; it must be picklable, for calls run on the executors."""

    def embed(self, content: str) -> list[float]: ...


class HashingProvider:
    """Deterministic offline provider: signed feature hashing of words, at length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, content: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in (content or "").lower().split():
            h = hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest()
            n = int.from_bytes(h, "big")
            v[n % self.dim] += 1.0 if (n >> 40) & 1 else -1.0
        if not v.any():
            raise ValueError("nothing to embed")
        return (v / np.linalg.norm(v)).tolist()


class FailingProvider:
    """A provider for tests: items with a marked text always fail, others as often as told."""

    def __init__(self, inner: Provider, marker: str = "broken"):
        self.inner, self.marker = inner, marker

    def embed(self, content: str) -> list[float]:
        if self.marker in (content or ""):
            raise RuntimeError("codec unsupported")
        return self.inner.embed(content)


def with_retries(call: Callable, retries: int = config.RETRIES, first_wait: float = config.FIRST_BACKOFF, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a failure waits 2, 4, 8... seconds and tries again; raises the last failure."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(first_wait * 2**attempt)


def call_provider(rows: DataFrame, provider: Provider, content: str = "content", concurrency: int = 5, retries: int = config.RETRIES, first_wait: float = config.FIRST_BACKOFF) -> DataFrame:
    """``(sample_id, embedding, embedding_error)``: one of the last two is null.

    Calls of a partition run ``concurrency`` at a time. The caller must write the result before using it
    twice, or a recomputation would call the service again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(item: str):
            try:
                return with_retries(lambda: provider.embed(item), retries, first_wait), None
            except Exception as e:
                return None, f"{type(e).__name__}: {str(e)[:200]}"

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                answers = list(pool.map(one, b[content]))
                yield pd.DataFrame({"sample_id": b["sample_id"], "embedding": [a for a, _ in answers], "embedding_error": [e for _, e in answers]})

    return rows.select(F.col("sample_id").cast("string").alias("sample_id"), content).mapInPandas(run, ANSWER)


def status(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """``samples`` with ``status``: already_embedded, cache_hit, or to be fetched; and the cached vector."""
    looked = cache_tables.lookup(samples, cache)
    return looked.withColumn("status", F.when(F.col("embedding").isNotNull(), "already_embedded").when(F.col("cached").isNotNull(), "cache_hit").otherwise("fetch"))


def embed_all(samples: DataFrame, cache: DataFrame, provider: Provider, scratch, content: str = "content", first_wait: float = config.FIRST_BACKOFF) -> tuple[DataFrame, DataFrame]:
    """``(samples with embedding, error and status, new cache entries)``; the service is asked once per missing hash."""
    known = scratch.write(status(samples, cache), "status")
    asked = known.where("status = 'fetch'").groupBy("file_hash").agg(F.min_by(content, F.col("sample_id")).alias(content))
    answers = call_provider(asked.withColumn("sample_id", F.col("file_hash")), provider, content, first_wait=first_wait)
    fetched = scratch.write(answers.select(F.col("sample_id").alias("file_hash"), F.col("embedding").alias("_e"), F.col("embedding_error").alias("_err")), "fetched")
    joined = known.drop("embedding_error").join(fetched, "file_hash", "left")
    fetch = F.col("status") == "fetch"
    done = joined.select(
        *[c for c in samples.columns if c not in ("embedding", "embedding_error")],
        F.coalesce("embedding", "cached", "_e").alias("embedding"),
        F.when(fetch, F.col("_err")).alias("embedding_error"),
        F.when(fetch & F.col("_e").isNotNull(), "api").when(fetch, "failed").otherwise(F.col("status")).alias("status"),
    )
    entries = fetched.where("_e IS NOT NULL").select(
        "file_hash", F.col("_e").cast("array<float>").alias("embedding"), F.size("_e").alias("dim"), F.lit("float32").alias("dtype"), F.lit(time.time()).alias("created_at")
    )
    return done, entries


def status_counts(embedded: DataFrame) -> DataFrame:
    return embedded.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def failure_reasons(samples: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent failure reasons; ties go to the alphabet."""
    failed = samples.where(F.col("embedding_error").isNotNull() & (F.col("embedding_error") != ""))
    return failed.groupBy(F.col("embedding_error").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def embed_categories(leaves: DataFrame, provider: Provider) -> DataFrame:
    """``(child, v)``: unit vectors of category names; names the provider fails on are left out."""
    answers = call_provider(leaves.select(F.col("child").alias("sample_id"), F.col("child").alias("content")), provider, first_wait=0.0)
    from lacuna.functions import vectors

    return answers.where("embedding IS NOT NULL").select(F.col("sample_id").alias("child"), vectors.l2_normalize(F.col("embedding")).alias("v"))
