"""Readers of the parquet tables, and the views of them that operators start from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import vectors


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """One row per key: the one with the greatest version.

    Rows without a key are left out, a null version is older than any other, and of rows equal in key
    and version (copies) one is taken by a hash of its content, so the choice does not depend on file
    order. One shuffle; the aggregate keeps one row per key on the map side, so a key that was
    delivered a million times costs no more than one delivered once.
    """
    rest = [c for c in columns if c != key]
    body = F.struct(*rest)
    order = F.struct(F.col(version), F.xxhash64(*rest))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(body, order).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in columns])


def current_samples(samples: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of every sample (greatest ``updated_at``)."""
    return latest(samples, "sample_id", "updated_at", columns)


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int = 64) -> DataFrame:
    """``(key, v)`` with v the unit vector as 32-bit floats, for the rows whose vector is usable."""
    kept = df.where(vectors.usable(F.col(vector), dim)).select(F.col(key), F.col(vector).cast("array<double>").alias("v"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = vectors.unit_rows(vectors.matrix(b["v"])).astype(np.float32)
                yield pd.DataFrame({key: b[key], "v": list(v)})

    kind = df.schema[key].dataType.simpleString()
    return kept.mapInPandas(unit, f"`{key}` {kind}, v array<float>")
