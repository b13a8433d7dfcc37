"""Incremental ingestion: new samples are embedded as they arrive, cache first, and appended to a table.

Every micro-batch is keyed by its number: a batch that is run again after a failure replaces its own
folder, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lacuna.operators import embedding, projection
from lacuna.runtime import Scratch
from lacuna.sources.cache import EmbeddingCache


def embed_batch(cache: EmbeddingCache, provider: embedding.Provider, out: str, content: str = "content", first_wait: float = 2.0) -> Callable[[DataFrame, int], None]:
    """The work of one micro-batch: rows (sample_id, content) to ``out/batch=N``, new vectors to the cache."""

    def run(rows: DataFrame, number: int) -> None:
        new = rows.where(F.col("sample_id").isNotNull()).dropDuplicates(["sample_id"])
        new = new.withColumn("file_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
        new = new.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("embedding_error", F.lit(None).cast("string"))
        done, entries = embedding.embed_all(new, cache.read(), provider, Scratch(rows.sparkSession), content, first_wait)
        done.drop(content).write.mode("overwrite").parquet(f"{out}/batch={number}")
        cache.put(entries)

    return run


def ingest(stream: DataFrame, cache: EmbeddingCache, provider: embedding.Provider, out: str, checkpoint: str, content: str = "content", first_wait: float = 2.0) -> StreamingQuery:
    """Starts the stream; it takes what there is and ends (``availableNow``), and goes on from there when started again."""
    work = embed_batch(cache, provider, out, content, first_wait)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def projected(rows: DataFrame, name: str, base: str, vector: str = "v") -> tuple[DataFrame, bool]:
    """Rows in the stored projection, refitted (and stored) when too many ids are new; and whether it was refitted."""
    known = projection.load(rows.sparkSession, name, base)
    ids = rows.select("sample_id")
    if known is not None and not projection.drift(known["ids"], ids).first()["retrain"]:
        return projection.transform(known["model"], rows, vector), False
    model = projection.fit(rows, vector)
    if model is not None:
        projection.save(model, name, ids, base)
    return projection.transform(model, rows, vector), True
