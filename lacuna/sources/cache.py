"""Embedding cache: a parquet table keyed by content hash, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_hash string, embedding array<float>, dim int, dtype string, created_at double"


def valid(cache: DataFrame) -> DataFrame:
    """Entries whose vector has the length that was written with it."""
    return cache.where(F.col("file_hash").isNotNull() & (F.size("embedding") == F.col("dim")))


def compact(cache: DataFrame) -> DataFrame:
    """One entry per hash: the latest; of copies one by a hash of its content. Combines on the map side."""
    body = F.struct("embedding", "dim", "dtype", "created_at")
    order = F.struct(F.col("created_at"), F.xxhash64("embedding", "dim", "dtype"))
    last = cache.where(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.max_by(body, order).alias("e"))
    return last.select("file_hash", "e.*")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after writing ``new``; vectors are kept as 32-bit floats."""
    return compact(cache.unionByName(new.withColumn("embedding", F.col("embedding").cast("array<float>"))))


def lookup(samples: DataFrame, cache: DataFrame) -> DataFrame:
    """``samples`` with ``cached`` (doubles, or null on a miss) by ``file_hash``; an entry of a wrong length is a miss."""
    hits = valid(compact(cache)).select("file_hash", F.col("embedding").cast("array<double>").alias("cached"))
    return samples.join(hits, "file_hash", "left")


def misses(samples: DataFrame, cache: DataFrame) -> DataFrame:
    return samples.join(valid(compact(cache)).select("file_hash"), "file_hash", "left_anti")


class EmbeddingCache:
    """The table in a folder: opened (created if absent), read, written, cleared, counted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        fs, target = self._target()
        aside = target.suffix(".old")
        if not self._exists() and fs.exists(aside):  # a swap was broken off between its two renames
            fs.rename(aside, target)
        if not self._exists():
            spark.createDataFrame([], SCHEMA).write.parquet(path)

    def __enter__(self) -> EmbeddingCache:
        return self

    def __exit__(self, *_: object) -> None:
        return None

    def _target(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self) -> bool:
        fs, target = self._target()
        return bool(fs.exists(target))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, new: DataFrame) -> None:
        """Appends; ``read`` through ``compact`` gives the last write of each hash."""
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        new.withColumn("embedding", F.col("embedding").cast("array<float>")).select(*names).write.mode("append").parquet(self.path)

    def compact(self) -> None:
        """Rewrites the table with one entry per hash, beside the old one, then swaps the folders.

        The old folder goes only when the new one is in place; opening the cache after a crash in between finds one of them.
        """
        fs, target = self._target()
        fresh = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + ".new")
        compact(self.read()).write.mode("overwrite").parquet(self.path + ".new")
        aside = target.suffix(".old")
        fs.delete(aside, True)
        fs.rename(target, aside)
        fs.rename(fresh, target)
        fs.delete(aside, True)

    def clear(self) -> int:
        n = compact(self.read()).count()
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(self.path)
        return n

    def stats(self) -> dict:
        fs, target = self._target()
        return {"entries": compact(self.read()).count(), "path": self.path, "size_bytes": fs.getContentSummary(target).getLength()}
