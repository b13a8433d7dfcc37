"""Top N items within every group, with a hot-cold split.

Exact counts decide: heavy groups are range-sorted over salted slices, each slice keeps its own first N
and a last window ranks at most N per slice; light groups go to ordinary windows. Both parts are unioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(rows: DataFrame, group: str, order: list[Column], n: int, heavy_share: float = 0.002, heavy_least: int = 10_000) -> DataFrame:
    """``rows`` with a column ``rank`` (1..n): the first ``n`` of each group in ``order``.

    ``order`` must end in a unique column for the result to be fixed. A group is heavy if it holds more
    than ``max(heavy_least, heavy_share * all rows)`` rows, so there are at most ``1 / heavy_share`` heavy
    groups; only their keys reach the driver. A null group is a group. Groups smaller than n come out whole.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    spark = rows.sparkSession
    total = counts.agg(F.sum("_n")).first()[0] or 0
    limit = max(heavy_least, int(heavy_share * total))
    heavy = [(r[0],) for r in counts.where(F.col("_n") > limit).select(group).collect()]

    def ranked(df: DataFrame, *keys: str | Column) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)

    if not heavy:
        return ranked(rows, group)
    keys = spark.createDataFrame(heavy, rows.select(F.col(group).alias("_topn_group")).schema)
    same = F.col(group).eqNullSafe(F.col("_topn_group"))
    light = rows.join(F.broadcast(keys), same, "left_anti")
    hot = rows.join(F.broadcast(keys), same, "left_semi")
    slices = max(8, spark.sparkContext.defaultParallelism * 2, 4 * total // max(1, limit) // 100)
    spread = hot.repartitionByRange(slices, F.col(group), *order).withColumn("_topn_slice", F.spark_partition_id())
    first = ranked(spread, group, "_topn_slice").drop("rank", "_topn_slice")
    return ranked(light, group).unionByName(ranked(first, group))


def nearest_in_cluster(samples: DataFrame, n: int = 3) -> DataFrame:
    """``(cluster_id, sample_id, centroid_distance, rank)`` of current rows: the n smallest distances per cluster.

    Rows with a null or negative cluster, or a distance that is null, not a number or outside [0, 2], do
    not count. 0.0 and -0.0 are equal; ties go to the smaller ``sample_id``. Repeated rows count once
    (``samples`` must hold current rows); an empty table gives an empty result.
    """
    d = F.col("centroid_distance")
    rows = samples.where((F.col("cluster_id") >= 0) & ~F.isnan(d) & d.between(0.0, 2.0)).select(
        "cluster_id", "sample_id", (d + F.lit(0.0)).alias("centroid_distance")
    )
    return top_n(rows, "cluster_id", [F.col("centroid_distance").asc(), F.col("sample_id").asc()], n)
