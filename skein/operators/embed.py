"""Embedding texts through a provider, with cost, cache and totals."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import sha256, token_estimate
from skein.functions.vectors import normalized
from skein.schema import DEFAULT_DIMENSION, DEFAULT_PRICE, EMBEDDING_MODELS, BackoffConfig
from skein.session import ensure_importable, sliced


class Provider(Protocol):
    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]: ...


class HashProvider:
    """A deterministic stand-in: components from a seeded generator, so equal texts have equal vectors."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: Sequence[str], model: str) -> list[list[float]]:
        seeds = (int.from_bytes(hashlib.sha256(f"{model}\n{t}".encode()).digest()[:8], "big") for t in texts)
        return [np.random.default_rng(s).normal(size=self.dimension).tolist() for s in seeds]


class TransientError(Exception):
    """A failure of a provider that is worth another try."""


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMBEDDING_MODELS, "model string, dimension int, price double")


def price_of(model: Column) -> Column:
    out = F.lit(DEFAULT_PRICE)
    for name, _, price in EMBEDDING_MODELS:
        out = F.when(model == name, price).otherwise(out)
    return out


def dimension_of(model: Column) -> Column:
    out = F.lit(DEFAULT_DIMENSION)
    for name, dimension, _ in EMBEDDING_MODELS:
        out = F.when(model == name, dimension).otherwise(out)
    return out


def cost(tokens: Column, model: Column) -> Column:
    return tokens / 1e6 * price_of(model)


#: Most texts in one call of a provider, and in one request for a batch.
MOST_IN_CALL, MOST_IN_REQUEST = 2048, 100
#: What is worth another try, besides TransientError.
PASSING = (ConnectionError, TimeoutError)


def embed(texts: DataFrame, provider: Callable[[], Provider], batch: int = 25, tries: int = 3, backoff: BackoffConfig | None = None) -> DataFrame:
    """(text_hash, model, embedding, tokens_used, cost_usd) of the distinct pairs of text and model in texts(text, model).

    Equal requests are sent once. Batches hold one model only. Transient errors, lost connections and timeouts are tried
    again up to `tries` times in all, after a wait that grows by backoff's base (at once without it); any other failure
    fails the task, which Spark runs again.
    """
    if not 1 <= batch <= MOST_IN_CALL:
        raise ValueError(f"batch must be 1 to {MOST_IN_CALL}")
    ensure_importable(texts.sparkSession)
    once = texts.where(F.col("text").isNotNull()).groupBy(sha256(F.col("text")).alias("text_hash"), "model").agg(F.min("text").alias("text"))

    def call(it: Provider, part: list[str], model: str) -> list[list[float]]:
        for attempt in range(tries):
            try:
                return it.embed(part, model)
            except (TransientError, *PASSING):
                if attempt == tries - 1:
                    raise
                if backoff:
                    time.sleep(min(backoff.initial * backoff.base**attempt, backoff.most))
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = provider()
        for rows in sliced(batches):
            hashes, models, bodies = (rows[c].to_pylist() for c in ("text_hash", "model", "text"))
            out: list[list[float] | None] = [None] * len(bodies)
            for model in dict.fromkeys(models):
                at = [i for i, m in enumerate(models) if m == model]
                for k in range(0, len(at), batch):
                    for i, v in zip(at[k : k + batch], call(it, [bodies[i] for i in at[k : k + batch]], model), strict=True):
                        out[i] = v
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(models, pa.string()), pa.array(bodies), pa.array(out, pa.list_(pa.float64()))], ["text_hash", "model", "text", "raw"])

    raw = once.select("text_hash", "model", "text").mapInArrow(run, "text_hash string, model string, text string, raw array<double>")
    tokens = token_estimate(F.col("text"))
    return raw.select("text_hash", "model", normalized(F.col("raw")).alias("embedding"), tokens.alias("tokens_used"), cost(tokens, F.col("model")).alias("cost_usd"))


def embed_batch(texts: DataFrame, provider: Callable[[], Provider], **options) -> tuple[DataFrame, DataFrame]:
    """(results, totals) of one request for 1 to 100 texts; the cache isn't asked."""
    if not 1 <= (n := texts.limit(MOST_IN_REQUEST + 1).count()) <= MOST_IN_REQUEST:
        raise ValueError(f"1 to {MOST_IN_REQUEST} texts, not {n if n <= MOST_IN_REQUEST else 'more'}")
    results = embed(texts, provider, **options)
    return results, totals(results)


def totals(results: DataFrame) -> DataFrame:
    """One row: how many, tokens, cost and mean cost."""
    n = F.count("*")
    return results.agg(n.alias("embeddings"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), F.coalesce(F.round(F.sum("cost_usd"), 8), F.lit(0.0)).alias("cost"), F.coalesce(F.round(F.sum("cost_usd") / n, 6), F.lit(0.0)).alias("mean_cost"))


def cache_key(text: Column) -> Column:
    return F.concat(F.lit("embedding:"), sha256(text))


def looked_up(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests(text, model, ...) with hit and embedding from cache(text_hash, model, embedding, expires_at)."""
    live = cache.where(F.col("expires_at") > now).groupBy("text_hash", "model").agg(F.max_by("embedding", "expires_at").alias("embedding"))
    keyed = requests.withColumn("text_hash", sha256(F.col("text")))
    return keyed.join(live, ["text_hash", "model"], "left").withColumn("hit", F.col("embedding").isNotNull())


def cache_stats(lookups: DataFrame) -> DataFrame:
    hits, n = F.count_if("hit"), F.count("*")
    return lookups.agg(hits.alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(hits, n), F.lit(0.0)).alias("hit_rate"))


def stored(cache: DataFrame, fresh: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """cache with fresh(text_hash, model, embedding) put in: the latest entry of each key stays."""
    added = fresh.select("text_hash", "model", "embedding", (now + F.make_dt_interval(days=F.lit(days))).alias("expires_at"))
    both = cache.unionByName(added)
    return both.groupBy("text_hash", "model").agg(F.max(F.struct("expires_at", "embedding")).alias("x")).select("text_hash", "model", "x.embedding", "x.expires_at")


def evicted(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys, keys.columns, "left_anti")


def cleared(cache: DataFrame, model: str | None = None) -> tuple[DataFrame, int]:
    """(cache without the entries of a model, or of all models; how many went)."""
    gone = F.lit(True) if model is None else F.coalesce(F.col("model") == model, F.lit(False))
    return cache.where(~gone), cache.where(gone).count()


def cached_embed(requests: DataFrame, cache: DataFrame, now: Column, provider: Callable[[], Provider]) -> tuple[DataFrame, DataFrame]:
    """(requests with embedding and hit, what to put into the cache): misses are embedded once, then joined back."""
    found = looked_up(requests, cache, now)
    fresh = embed(found.where(~F.col("hit")).select("text", "model"), provider)
    filled = found.where(~F.col("hit")).drop("embedding").join(fresh.select("text_hash", "model", "embedding"), ["text_hash", "model"], "left")
    return found.where("hit").unionByName(filled.select(*found.columns)), fresh
