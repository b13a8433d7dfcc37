"""K-means on unit vectors, with Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import config

#: Rows of a partition while fitting.
PARTITION_ROWS = 20_000


def clusters_for(wanted: int, n: int) -> int:
    """Clusters to fit: more than the rows become one less than the rows, at least one."""
    return max(1, n - 1 if wanted > n else wanted)


def kmeans(rows: DataFrame, id_: str, k: int, vector: str = "v", runs: int = config.KMEANS_RUNS, seed: int = config.SEED) -> DataFrame:
    """``(id, cluster_id)``: the best of ``runs`` fits by cost, whatever the size; one cluster if k is 1 or less.

    There are no more clusters than different vectors.

    Rows are dealt to partitions by a hash of their id and sorted there, so that the fit does not depend on how they were read.
    """
    n = rows.count()
    k = min(clusters_for(k, n), rows.select(F.xxhash64(vector).alias("h")).distinct().limit(max(1, k)).count())
    if k <= 1:
        return rows.select(id_, F.lit(0).alias("cluster_id"))
    data = rows.select(id_, array_to_vector(F.col(vector)).alias("features"))
    data = data.repartition(-(-n // PARTITION_ROWS), id_).sortWithinPartitions(id_).persist()
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(data) for i in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return best.transform(rows.select(id_, array_to_vector(F.col(vector)).alias("features"))).select(id_, F.col("prediction").alias("cluster_id"))
