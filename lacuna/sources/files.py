"""Files as tables: paths, sizes and content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import config
from lacuna.functions import text


def scan_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(filepath, length, modified)`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("filepath"), "length", F.col("modificationTime").alias("modified"))


def hash_files(spark: SparkSession, folder: str, glob: str = "*", first_bytes: int = config.HASH_BYTES) -> DataFrame:
    """``(filepath, file_hash)``: SHA-256 of the first bytes of each file.

    Files of a local or mounted file system are opened by the tasks and read no further, so their size does not
    matter; others come whole through Spark's file source, which ends at 2 GB.
    """
    files = scan_files(spark, folder, glob).select("filepath")
    if not spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        whole = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        return whole.select(F.col("path").alias("filepath"), text.content_hash(F.col("content"), first_bytes).alias("file_hash"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["filepath"]:
                digest, left = hashlib.sha256(), first_bytes
                with open(unquote(urlparse(path).path), "rb") as f:
                    while left > 0 and (piece := f.read(min(left, 1 << 20))):
                        digest.update(piece)
                        left -= len(piece)
                found.append(digest.hexdigest())
            yield pd.DataFrame({"filepath": b["filepath"], "file_hash": found})

    return files.mapInPandas(hashed, "filepath string, file_hash string")
