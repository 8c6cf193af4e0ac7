"""The embedding cache as a table of base and deltas: storing writes the new entries only, a look-up reads its keys' buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import sha256
from skein.operators import embed
from skein.operators.ledger import Ledger, Table

KEY = ("text_hash", "model")
SCHEMA = "text_hash string, model string, embedding array<double>, expires_at timestamp"


class EmbeddingCache:
    """Entries by text and model. Writers may work at the same time: of two entries of one key the one committed later stays."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.ledger = Ledger(spark, root, {"cache": Table(SCHEMA, KEY, buckets)})

    def entries(self) -> DataFrame:
        return self.ledger.read("cache")

    def looked_up(self, requests: DataFrame, now: Column) -> DataFrame:
        """embed.looked_up over the buckets of the requests' keys."""
        keys = requests.select(sha256(F.col("text")).alias("text_hash"), "model")
        return embed.looked_up(requests, self.ledger.looked_up("cache", keys), now)

    def store(self, fresh: DataFrame, now: Column, days: int = 30) -> None:
        """Put fresh(text_hash, model, embedding) in, to expire after some days."""
        self.put(fresh.withColumn("expires_at", now + F.make_dt_interval(days=F.lit(days))))

    def put(self, entries: DataFrame) -> None:
        """Entries with the time they expire at; of several of one key the one that lasts longest is put in."""
        once = entries.groupBy(*KEY).agg(F.max_by("embedding", "expires_at").alias("embedding"), F.max("expires_at").alias("expires_at"))
        self.ledger.tried(lambda _: ({"cache": once}, None))

    def evict(self, keys: DataFrame) -> None:
        """Entries of keys(text_hash, model), or of keys(text_hash) for all models."""
        known = self.ledger.last()
        hit = self.ledger.read("cache", known).join(keys, keys.columns, "left_semi").select(*KEY)
        self.ledger.commit({}, known, {"cache": hit})

    def compact(self, now: Column) -> None:
        """One base again, without the entries that have expired."""
        self.ledger.compact("cache", F.col("expires_at") > now)

    def embed(self, requests: DataFrame, now: Column, provider: Callable[[], embed.Provider], days: int = 30) -> DataFrame:
        """requests with hit and embedding; what had to be embedded is stored first."""
        keys = requests.select(sha256(F.col("text")).alias("text_hash"), "model")
        before = self.ledger.last()
        missing = embed.looked_up(requests, self.ledger.looked_up("cache", keys), now).where(~F.col("hit"))
        self.store(embed.embed(missing.select("text", "model"), provider), now, days)
        old = self.ledger.read("cache", before).where(F.col("expires_at") > now).select(*KEY).withColumn("old_", F.lit(True))
        found = self.looked_up(requests, now).join(old, list(KEY), "left")
        return found.withColumn("hit", F.coalesce("old_", F.lit(False))).drop("old_")
