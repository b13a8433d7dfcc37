"""Session helpers: scratch tables that survive executor loss, and input spreading."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The parquet writer asks for a page's size only after 100 rows; with packed rows of a megabyte such pages, and the buffers to compress them, are huge.
#: It holds a row group until that is full, and a reader unpacks up to 4,096 rows of one at once, so row groups are small too.
SMALL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one of our own, but on one machine only.

    On a cluster every executor would write to a disk of its own, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_lacuna_shared", None)
    if own is None:
        own = sc._lacuna_shared = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        sc.setCheckpointDir(own)
    return own


#: Whether Spark removes the shuffle files of a query when it has ended; else they stay until the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The queries that run inside leave no shuffle files on the executors' disks."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


class Scratch:
    """Intermediate tables written once to the shared folder and read back.

    A written table cuts lineage like ``checkpoint()`` but computes its input only once and keeps it
    columnar. ``drop`` frees a table that no later step reads; the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/lacuna-{uuid.uuid4().hex}"
        atexit.register(self.remove, self.base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite").options(**SMALL_PAGES | (options or {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with shuffles_freed(self.spark):
            writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self.remove(self.path(name))

    def remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone by now; the folder is scratch anyway
            pass


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Repartition only if the input has fewer partitions than ``factor`` times the cores.

    Large inputs already come in enough splits and are left alone, so nothing is shuffled there.
    """
    wanted = max(2, df.sparkSession.sparkContext.defaultParallelism * factor)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
