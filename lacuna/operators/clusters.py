"""Cluster statistics: centroids, distances, sizes, isolation, representatives, labels, health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna import config
from lacuna.functions import scoring
from lacuna.functions import vectors as vec
from lacuna.operators import balls, blocks

IN_CLUSTER = "cluster_id >= 0"


def embedded(samples: DataFrame, dim: int = 64) -> DataFrame:
    """Rows with a usable embedding, with the unit vector ``v`` added."""
    return samples.where(vec.usable(F.col("embedding"), dim)).withColumn("v", vec.l2_normalize(F.col("embedding")))


def clustered(samples: DataFrame, dim: int = 64) -> DataFrame:
    """Rows with embedding, cluster and finite 2-D position."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(vec.INF)) for c in ("umap_x", "umap_y")]
    return embedded(samples, dim).where(F.col("cluster_id").isNotNull() & finite[0] & finite[1])


def centroids(rows: DataFrame, group: str = "cluster_id", dim: int = 64) -> DataFrame:
    """``(group, n, centroid)``: the mean of the unit vectors ``v``, at length one; a zero mean stays zero.

    One sum column per dimension, so the aggregate combines on the map side and a hot group is no burden.
    """
    sums = [F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(dim)]
    means = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums)
    return means.select(group, "n", vec.l2_normalize(F.array(*[f"_{i}" for i in range(dim)])).alias("centroid"))


def distances(rows: DataFrame, cents: DataFrame, group: str = "cluster_id") -> DataFrame:
    """``rows`` with ``distance``: cosine distance to the centroid of their own group."""
    return rows.join(cents.select(group, "centroid"), group).withColumn("distance", vec.cosine_distance(F.col("v"), F.col("centroid"))).drop("centroid")


def nearest_centroid(rows: DataFrame, cents: DataFrame, id_: str = "sample_id") -> DataFrame:
    """``(id, cluster_id, similarity)``: the nearest centroid of each row; ties go to the lower cluster."""
    return blocks.nearest(rows, id_, "v", cents.where(IN_CLUSTER), "cluster_id", "centroid")


def sizes(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def sparse(samples: DataFrame, threshold: int = config.SPARSE_THRESHOLD) -> DataFrame:
    """Clusters (noise aside) with fewer rows than the threshold."""
    return sizes(samples).where(IN_CLUSTER).where(F.col("size") < threshold)


def isolation(cents: DataFrame) -> DataFrame:
    """``(cluster_id, isolation)``: distance to the nearest other centroid; 0 for a cluster alone."""
    peers = blocks.nearest(cents.where(IN_CLUSTER), "cluster_id", "centroid", cents.where(IN_CLUSTER), "cluster_id", "centroid", exclude_self=True)
    near = peers.select("cluster_id", F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - F.col("similarity"))).alias("isolation"))
    return cents.where(IN_CLUSTER).select("cluster_id").join(near, "cluster_id", "left").select("cluster_id", F.coalesce("isolation", F.lit(0.0)).alias("isolation"))


def isolated(cents: DataFrame, factor: float = config.ISOLATION_STD_FACTOR, dim: int = 64) -> DataFrame:
    """``(cluster_id, mean_distance, threshold)``: clusters whose mean distance to the others exceeds mean + factor * std.

    The mean over all others comes from the sum of all centroids, so no pair of clusters is formed.
    Fewer than three clusters have no isolated one.
    """
    own = cents.where(IN_CLUSTER).select("cluster_id", "centroid")
    total = own.agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.col("centroid")[i]).alias(f"_{i}") for i in range(dim)]).select(
        "k", F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(dim)]).alias("_sum")
    )
    others = (vec.dot(F.col("centroid"), F.col("_sum")) - vec.dot(F.col("centroid"), F.col("centroid"))) / (F.col("k") - 1)
    mean = own.crossJoin(F.broadcast(total)).where("k >= 3").select("cluster_id", (1.0 - others).alias("mean_distance"))
    bound = mean.agg((F.avg("mean_distance") + factor * F.stddev_pop("mean_distance")).alias("threshold"))
    return mean.crossJoin(F.broadcast(bound)).where("mean_distance > threshold")


def outliers(rows: DataFrame, factor: float = config.OUTLIER_STD_FACTOR) -> DataFrame:
    """``rows`` with ``outlier``: distance above mean + factor * population std of all; none if all are equal."""
    bound = rows.agg(F.avg("distance").alias("_m"), F.stddev_pop("distance").alias("_s"))
    flagged = rows.crossJoin(F.broadcast(bound)).withColumn("outlier", (F.col("_s") > 0) & (F.col("distance") > F.col("_m") + factor * F.col("_s")))
    return flagged.drop("_m", "_s")


def centres_2d(rows: DataFrame) -> DataFrame:
    return rows.where(IN_CLUSTER).groupBy("cluster_id").agg(F.avg("umap_x").alias("x"), F.avg("umap_y").alias("y"))


def ranked_by_distance(rows: DataFrame, n: int, farthest: bool = False) -> DataFrame:
    """The n nearest (or farthest) rows of each cluster with their ``rank``; ties go to the smaller id.

    The rank limit is applied before the shuffle, so a task sends at most n rows per cluster.
    """
    d = F.col("distance").desc() if farthest else F.col("distance").asc()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(d, "sample_id"))).where(F.col("rank") <= n)


def representatives(rows: DataFrame, nearest: int = 2, boundary: int = 1, random: int = 1, seed: int = config.SEED) -> DataFrame:
    """``(cluster_id, sample_id, role)``: nearest, then boundary, then random rows of each cluster, each row once.

    A row keeps its first role. Random rows are those with the smallest seeded hash among the rest.
    """
    own = rows.where(IN_CLUSTER).select("cluster_id", "sample_id", "distance")
    near = ranked_by_distance(own, nearest).select("cluster_id", "sample_id", F.lit(0).alias("o"))
    far = ranked_by_distance(own, boundary, farthest=True).select("cluster_id", "sample_id", F.lit(1).alias("o"))
    fixed = near.unionByName(far).groupBy("cluster_id", "sample_id").agg(F.min("o").alias("o"))
    if random:
        by_hash = Window.partitionBy("cluster_id").orderBy(F.xxhash64("sample_id", F.lit(seed) + F.col("cluster_id")), "sample_id")
        drawn = own.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= nearest + boundary + random)
        rest = drawn.join(fixed.select("cluster_id", "sample_id"), ["cluster_id", "sample_id"], "left_anti")
        pick = rest.withColumn("_k", F.row_number().over(Window.partitionBy("cluster_id").orderBy("_r"))).where(F.col("_k") <= random)
        fixed = fixed.unionByName(pick.select("cluster_id", "sample_id", F.lit(2).alias("o")))
    role = F.when(F.col("o") == 0, "nearest").when(F.col("o") == 1, "boundary").otherwise("random")
    return fixed.select("cluster_id", "sample_id", role.alias("role"))


def label_map(samples: DataFrame) -> DataFrame:
    """``(cluster_id, label)``: the label of each cluster's first row (by id); ``Cluster N`` where it is empty."""
    first = samples.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.min_by(F.coalesce("cluster_label", F.lit("")), F.col("sample_id")).alias("label"))
    return first.select("cluster_id", default_label(F.col("label"), F.col("cluster_id")).alias("label"))


def default_label(label: Column, cluster: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Cluster "), cluster.cast("string")))


def apply_labels(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """``samples`` with ``new_label``: noise gets the noise label, clusters theirs, others keep their own."""
    joined = samples.join(labels.select("cluster_id", F.col("label").alias("_label")), "cluster_id", "left")
    return joined.withColumn("new_label", F.when(F.col("cluster_id") == config.NOISE, config.NOISE_LABEL).otherwise(F.coalesce("_label", "cluster_label"))).drop("_label")


def tag_sparse(samples: DataFrame, sparse_clusters: DataFrame) -> DataFrame:
    """``samples`` with the sparse tag added once to the rows of sparse clusters; ``newly`` marks rows it was new to."""
    marked = samples.join(sparse_clusters.select("cluster_id", F.lit(True).alias("_s")), "cluster_id", "left")
    tags, has = F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("_s", F.lit(False))
    newly = has & ~F.array_contains(tags, config.SPARSE_TAG)
    return marked.withColumn("newly", newly).withColumn("tags", F.when(newly, F.concat(tags, F.array(F.lit(config.SPARSE_TAG)))).otherwise(F.col("tags"))).drop("_s")


def full_breakdown(samples: DataFrame) -> DataFrame:
    """Per cluster: size, label, mean and greatest stored distance within [0, 2], health and its colour. Noise is not a cluster here."""
    d = F.when(F.col("centroid_distance").between(0.0, 2.0), F.col("centroid_distance"))  # not a number is above 2
    stats = samples.where(IN_CLUSTER).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.min_by(F.coalesce("cluster_label", F.lit("")), F.col("sample_id")).alias("cluster_label"),
        F.min_by(F.coalesce("cluster_diversity", F.lit("")), F.col("sample_id")).alias("cluster_diversity"),
        F.round(F.avg(d), 8).alias("mean_centroid_distance"),
        F.round(F.max(d), 8).alias("max_centroid_distance"),
    )
    health = scoring.cluster_health(F.col("size"), F.col("cluster_id"))
    return stats.withColumn("cluster_label", default_label(F.col("cluster_label"), F.col("cluster_id"))).withColumn("status", health).withColumn("status_color", scoring.health_colour(F.col("status")))


def silhouette(rows: DataFrame, dim: int = 64) -> DataFrame:
    """``(sample_id, cluster_id, silhouette)`` by cosine distance, exact; 0 in clusters of one row.

    The mean distance of a row to a cluster is 1 minus its product with the cluster's mean vector, so rows
    meet clusters (in blocks), never other rows.
    """
    own = rows.where(IN_CLUSTER).select("sample_id", "cluster_id", "v")
    means = own.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[i]).alias(f"_{i}") for i in range(dim)]).select(
        "cluster_id", "n", F.array(*[f"_{i}" for i in range(dim)]).alias("mean")
    )
    kind = own.schema["sample_id"].dataType.simpleString()

    def work(m, part: pd.DataFrame, keys, refs) -> pd.DataFrame:
        sims = m @ refs.T
        sims[part["cluster_id"].to_numpy()[:, None] == keys[None, :]] = -float("inf")
        return pd.DataFrame({"sample_id": part["sample_id"].to_numpy(), "b": 1.0 - sims.max(axis=1)})

    other = blocks.against(own, "v", ["sample_id", "cluster_id"], means, "cluster_id", "mean", f"sample_id {kind}, b double", work, lambda df: df.groupBy("sample_id").agg(F.min("b").alias("b")))
    a = (1.0 - vec.dot(F.col("v"), F.col("mean"))) * F.col("n") - (1.0 - vec.dot(F.col("v"), F.col("v")))
    inside = own.join(means, "cluster_id").select(
        "sample_id", "cluster_id", "n", F.when(F.col("n") > 1, a / F.greatest(F.lit(1), F.col("n") - 1)).alias("a")
    )
    s = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return inside.join(other, "sample_id").select("sample_id", "cluster_id", F.coalesce(F.when(F.col("n") > 1, s), F.lit(0.0)).alias("silhouette"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, ari)`` from the contingency counts of two labels; rows with a null label are left out."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    cells = both.agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("index"))
    side = lambda c, out: both.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(out))
    joined = cells.crossJoin(side(a, "sa")).crossJoin(side(b, "sb"))
    expected = F.col("sa") * F.col("sb") / (F.col("n").cast("double") * (F.col("n") - 1) / 2)
    top = (F.col("sa") + F.col("sb")) / 2
    return joined.select("n", F.when(top == expected, 1.0).otherwise((F.col("index") - expected) / (top - expected)).alias("ari"))


def pairwise_stats(rows: DataFrame, id_: str, vector: str = "v") -> DataFrame:
    """One row ``(pairs, mean, least, most)`` of the cosines of all ordered pairs of different rows."""
    return balls.pairwise_stats(rows, id_, vector)


def distance_summary(rows: DataFrame, id_: str, vector: str = "v") -> DataFrame:
    """``(id, others, mean_distance, least, most)``: cosine distances of each row to all other rows, in blocks."""
    kind = rows.schema[id_].dataType.simpleString()

    def work(m, part: pd.DataFrame, keys, refs) -> pd.DataFrame:
        import numpy as np

        d = np.clip(1.0 - m @ refs.T, 0.0, 2.0)
        d[blocks.same(part[id_].to_numpy(), keys)] = np.nan
        n = (~np.isnan(d)).sum(axis=1)
        some = n > 0
        d, ids = d[some], part[id_].to_numpy()[some]
        return pd.DataFrame({id_: ids, "others": n[some].astype(np.int64), "total": np.nansum(d, axis=1), "least": np.nanmin(d, axis=1) if len(d) else [], "most": np.nanmax(d, axis=1) if len(d) else []})

    def merge(df: DataFrame) -> DataFrame:
        return df.groupBy(id_).agg(F.sum("others").alias("others"), (F.sum("total") / F.sum("others")).alias("mean_distance"), F.min("least").alias("least"), F.max("most").alias("most"))

    return blocks.against(rows, vector, [id_], rows, id_, vector, f"`{id_}` {kind}, others long, total double, least double, most double", work, merge)


def core_distances(rows: DataFrame, id_: str, k: int, vector: str = "v") -> DataFrame:
    """``(id, core_distance)``: cosine distance to the k-th nearest other row (to the farthest if there are fewer)."""
    return balls.core_distances(rows, id_, k, vector)
