"""Category hierarchy, category match, gap priorities and rollups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna import config
from lacuna.functions import scoring, text
from lacuna.operators import blocks


def parse_hierarchy(spark: SparkSession, expected: str) -> DataFrame:
    """``(parent, parent_ord, child, child_ord)`` of ``a: x, y | b: z``."""
    groups = spark.createDataFrame([(expected,)], "t string").select(F.posexplode(text.hierarchy_groups(F.col("t"))).alias("parent_ord", "g"))
    return groups.select(F.col("g.parent").alias("parent"), "parent_ord", F.posexplode("g.children").alias("child_ord", "child")).select("parent", "parent_ord", "child", "child_ord")


def tidy_hierarchy(table: DataFrame) -> DataFrame:
    """A delivered hierarchy with white space trimmed and children in lower case."""
    return table.select(text._strip(F.col("parent")).alias("parent"), "parent_ord", F.lower(text._strip(F.col("child"))).alias("child"), "child_ord")


def unique_leaves(hierarchy: DataFrame) -> DataFrame:
    """``(child, first_ord)``: different leaves in order of their first use."""
    order = F.col("parent_ord") * F.lit(1_000_000) + F.col("child_ord")
    return hierarchy.groupBy("child").agg(F.min(order).cast("long").alias("first_ord"))


def match(leaves: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(child, cluster_id, sim_raw)``: the nearest centroid of each leaf (child, v); ties go to the lower cluster.

    Leaves without a vector do not come out, like leaves where there is no cluster.
    """
    return blocks.nearest(leaves.where(F.col("v").isNotNull()), "child", "v", centroids.where(F.col("cluster_id") >= 0), "cluster_id", "centroid").withColumnRenamed("similarity", "sim_raw")


def leaf_records(
    hierarchy: DataFrame, matched: DataFrame, isolation: DataFrame, labels: DataFrame, threshold: float = config.GAP_SIMILARITY, weights: tuple[float, float, float] = config.PRIORITY_WEIGHTS
) -> DataFrame:
    """Every leaf of the hierarchy that has a match: similarity, closest cluster, whether it is a gap, its priority.

    The test and the priority use the unrounded similarity. A leaf under two parents counts twice.
    """
    joined = (
        hierarchy.join(matched, "child")
        .join(isolation, "cluster_id", "left").join(labels.select("cluster_id", F.col("label").alias("closest_cluster")), "cluster_id", "left")
    )
    gap = F.col("sim_raw") < threshold
    priority = scoring.gap_priority(1.0 - F.col("sim_raw"), F.lit(True), F.coalesce("isolation", F.lit(0.0)), weights)
    return joined.select(
        "parent", "parent_ord", "child", "child_ord", F.col("cluster_id").alias("closest_cluster_id"),
        F.coalesce("closest_cluster", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("closest_cluster"),
        F.round("sim_raw", 4).alias("similarity"), gap.alias("is_gap"), F.when(gap, priority).alias("priority_score"), "sim_raw",
    )


def category_gaps(records: DataFrame) -> DataFrame:
    """The gaps among the leaves; order by descending priority, then by place in the hierarchy."""
    return records.where("is_gap").select("child", "parent", "closest_cluster", "similarity", "priority_score", "parent_ord", "child_ord")


def rollup(records: DataFrame) -> DataFrame:
    """Per parent: children, covered children, coverage and the best (rounded) similarity."""
    n, covered = F.count(F.lit(1)), F.sum((~F.col("is_gap")).cast("long"))
    return records.groupBy("parent_ord", "parent").agg(
        n.alias("n_children"), covered.alias("n_covered"), F.round(covered / n, 4).alias("coverage"), F.max("similarity").alias("best_similarity")
    )


def nested_hierarchy(records: DataFrame) -> DataFrame:
    """``rollup`` with the children as an array, in order."""
    child = F.struct("child_ord", F.col("child").alias("category"), "similarity", "closest_cluster", "closest_cluster_id", "is_gap", "priority_score")
    children = records.groupBy("parent_ord", "parent").agg(F.array_sort(F.collect_list(child)).alias("children"))
    return rollup(records).join(children, ["parent_ord", "parent"])


def category_coverage(records: DataFrame) -> DataFrame:
    """One row: leaves, covered leaves and their share (null without leaves)."""
    n, covered = F.count(F.lit(1)), F.coalesce(F.sum((~F.col("is_gap")).cast("long")), F.lit(0))
    return records.agg(n.alias("n_leaves"), covered.alias("n_covered"), F.when(n > 0, F.round(covered / n, 6)).alias("category_coverage"))


def marker_positions(gaps: DataFrame, leaf_positions: DataFrame, centres: DataFrame) -> DataFrame:
    """Gaps with a 2-D position: the leaf's own, else its closest cluster's centre, else the origin."""
    own = leaf_positions.select("child", F.col("x").alias("_x"), F.col("y").alias("_y"))
    centre = centres.select(F.col("cluster_id").alias("closest_cluster_id"), F.col("x").alias("_cx"), F.col("y").alias("_cy"))
    placed = gaps.join(own, "child", "left").join(centre, "closest_cluster_id", "left")
    zero = F.lit(0.0)
    return placed.withColumn("umap_x", F.coalesce("_x", "_cx", zero)).withColumn("umap_y", F.coalesce("_y", "_cy", zero)).drop("_x", "_y", "_cx", "_cy")


def sparse_ranked(sparse: DataFrame, isolation: DataFrame, labels: DataFrame, weights: tuple[float, float, float] = config.PRIORITY_WEIGHTS) -> DataFrame:
    """Sparse clusters with label and priority (no distance, not expected, isolation)."""
    joined = sparse.join(isolation, "cluster_id", "left").join(labels.select("cluster_id", "label"), "cluster_id", "left")
    priority = scoring.gap_priority(F.lit(0.0), F.lit(False), F.coalesce("isolation", F.lit(0.0)), weights)
    return joined.select("cluster_id", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("label"), F.col("size").alias("count"), priority.alias("priority_score"))


def all_gaps(categories: DataFrame, sparse: DataFrame) -> DataFrame:
    """Category gaps, then sparse clusters, as one table with the order in which ties are kept."""
    a = categories.select(
        F.lit("category").alias("type"), F.col("child").alias("name"), "priority_score", "closest_cluster", "similarity", F.lit(None).cast("int").alias("cluster_id"),
        F.lit(None).cast("long").alias("count"), F.lit(0).alias("type_ord"), (F.col("parent_ord") * F.lit(1_000_000) + F.col("child_ord")).cast("long").alias("ord"),
    )
    b = sparse.select(
        F.lit("sparse_cluster").alias("type"), F.concat(F.lit("Sparse: "), F.col("label")).alias("name"), "priority_score", F.col("label").alias("closest_cluster"),
        F.lit(None).cast("double").alias("similarity"), "cluster_id", "count", F.lit(1).alias("type_ord"), F.col("cluster_id").cast("long").alias("ord"),
    )
    return a.unionByName(b)


def priority_gaps(gaps: DataFrame, most: int = config.MAX_PRIORITY_GAPS) -> DataFrame:
    """The ``most`` gaps of the greatest priority with rank, severity and collection target."""
    order = [F.desc("priority_score"), "type_ord", "ord"]
    top = gaps.orderBy(*order).limit(most)  # a bounded report: the window below sees at most so many rows
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    target = scoring.collection_target(F.col("type"), F.col("priority_score"), F.col("count"))
    return ranked.withColumn("severity", scoring.severity(F.col("priority_score"))).withColumn("target", target)


def match_samples(leaves: DataFrame, rows: DataFrame, threshold: float = config.GAP_SIMILARITY_V1) -> DataFrame:
    """``(child, sample_id, sim_raw, is_gap)``: the nearest sample of each leaf (equal to 6 decimals: the smaller id); one pass over the samples per chunk of leaves.

    The samples stay where they are; the leaves (few) are broadcast, and each task sends its best sample per leaf.
    """
    kind = rows.schema["sample_id"].dataType.simpleString()

    def work(m, part, keys, refs):
        ids = part["sample_id"].to_numpy()
        order = ids.argsort(kind="stable")
        sims = m[order] @ refs.T
        best = sims.round(6).argmax(axis=0)  # equal to 6 decimals is a tie
        return pd.DataFrame({"child": keys, "sample_id": ids[order][best], "sim_raw": sims[best, range(len(keys))]})

    def merge(df):
        best = Window.partitionBy("child").orderBy(F.round("sim_raw", 6).desc(), "sample_id")
        return df.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")

    found = blocks.against(rows, "v", ["sample_id"], leaves.where(F.col("v").isNotNull()), "child", "v", f"child string, sample_id {kind}, sim_raw double", work, merge)
    return found.withColumn("is_gap", F.col("sim_raw") < threshold)
