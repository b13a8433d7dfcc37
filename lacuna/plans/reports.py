"""Report tables: executive summary, history entries, run-over-run difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna import config
from lacuna.functions import scoring, text


def totals(samples: DataFrame) -> DataFrame:
    """One row ``(n_samples, n_clusters)``: all rows, and different clusters of 0 or more."""
    return samples.agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("n_clusters"))


def recommendation(kind: Column, name: Column, closest: Column, priority: Column, count: Column, percent: Column) -> Column:
    """The sentence on the most urgent gap; ``kind`` is null where there is none."""
    points = F.bround(priority, 0).cast("int")
    near = F.when(F.coalesce(closest, F.lit("")) != "", F.format_string(config.NEAREST, text.truncate(closest, 50))).otherwise("")
    category = F.format_string(config.PRIORITISE, name, near, points)
    sparse = F.format_string(config.EXPAND, text.truncate(closest, 50), count, points)
    none = F.when(percent >= config.COVERAGE_BANDS[-1][0], config.STRONG_COVERAGE).otherwise(config.NO_CATEGORIES)
    return F.when(kind.isNull(), none).when(kind == "category", category).otherwise(sparse)


def collection_advice(kind: Column, name: Column, closest: Column, priority: Column, count: Column) -> Column:
    target = scoring.collection_target(kind, priority, count)
    label = F.coalesce(F.nullif(text.truncate(F.coalesce(closest, F.lit("")), 40), F.lit("")), F.lit("this cluster"))
    return F.when(kind == "category", F.format_string(config.COLLECT_CATEGORY, target, name)).otherwise(
        F.format_string(config.COLLECT_CLUSTER, target, label, F.coalesce(count, F.lit(0)))
    )


def top_gap(gaps: DataFrame) -> DataFrame:
    """The gap of the greatest priority; categories come before sparse clusters, then the given order."""
    return gaps.orderBy(F.desc("priority_score"), "type_ord", "ord").limit(1)


def executive_summary(score: DataFrame, samples: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: score, percent and its quality, totals, numbers of gaps, recommendation. ``score`` has one row (coverage_score)."""
    counts = gaps.agg(
        F.coalesce(F.sum((F.col("type") == "category").cast("long")), F.lit(0)).alias("n_category_gaps"),
        F.coalesce(F.sum((F.col("type") != "category").cast("long")), F.lit(0)).alias("n_sparse_clusters"),
    )
    one = score.crossJoin(totals(samples)).crossJoin(counts).withColumn("coverage_pct", F.round(F.col("coverage_score") * 100, 1))
    top = top_gap(gaps).select("type", "name", "closest_cluster", "priority_score", "count")
    joined = one.join(top, F.lit(True), "left")
    said = recommendation(F.col("type"), F.col("name"), F.col("closest_cluster"), F.col("priority_score"), F.col("count"), F.col("coverage_pct"))
    return joined.select(
        "coverage_score", "coverage_pct", scoring.coverage_quality(F.col("coverage_pct")).alias("coverage_quality"), "n_samples", "n_clusters", "n_category_gaps", "n_sparse_clusters",
        (F.col("n_category_gaps") + F.col("n_sparse_clusters")).alias("n_gaps_total"), said.alias("recommendation"),
    )


def history_entry(score: DataFrame, samples: DataFrame, gaps: DataFrame, timestamp: str) -> DataFrame:
    """One row in the form of ``coverage_history``."""
    listed = gaps.agg(
        F.array_sort(F.collect_list(F.struct("type_ord", "ord", F.struct("name", "priority_score", "type").alias("g")))).alias("_l"),
        F.coalesce(F.sum((F.col("type") != "category").cast("int")), F.lit(0)).cast("int").alias("n_sparse_clusters"),
    )
    return score.crossJoin(totals(samples)).crossJoin(listed).select(
        F.lit(timestamp).alias("timestamp"), F.col("coverage_score").cast("double").alias("coverage_score"), "n_samples", F.col("n_clusters").cast("int").alias("n_clusters"),
        "n_sparse_clusters", F.transform("_l", lambda x: x["g"]).alias("gaps"),
    )


def last_two_runs(history: DataFrame, series: str, order: list[Column]) -> DataFrame:
    """The last run of each series and the one before it, as ``n`` 1 and 2; the limit applies before the shuffle."""
    return history.withColumn("n", F.row_number().over(Window.partitionBy(series).orderBy(*order))).where("n <= 2")


def coverage_diff(history: DataFrame, series: str, order: list[Column]) -> DataFrame:
    """Per series with two runs: scores, deltas, sample numbers, closed, still open and newly opened gap names (sorted)."""
    two = last_two_runs(history, series, order)
    names = F.array_distinct(F.filter(F.transform(F.coalesce("gaps", F.array().cast("array<struct<name:string,priority_score:double,type:string>>")), lambda g: g["name"]), lambda n: n.isNotNull() & (n != "")))
    side = two.select(series, "n", "timestamp", "coverage_score", "n_samples", names.alias("names"))
    cur, prev = side.where("n = 1").alias("c"), side.where("n = 2").alias("p")
    delta = F.coalesce(F.col("c.coverage_score"), F.lit(0.0)) - F.coalesce(F.col("p.coverage_score"), F.lit(0.0))
    joined = cur.join(prev, series)
    return joined.select(
        series, F.col("p.timestamp").alias("previous_timestamp"), F.col("p.coverage_score").alias("coverage_score_prev"), F.col("c.coverage_score").alias("coverage_score_curr"),
        F.round(delta, 4).alias("coverage_delta"), F.round(delta * 100, 1).alias("coverage_delta_pct"), scoring.trend(F.round(delta, 4)).alias("trend"),
        F.col("p.n_samples").alias("n_samples_prev"), F.col("c.n_samples").alias("n_samples_curr"), (F.col("c.n_samples") - F.col("p.n_samples")).alias("new_samples"),
        F.array_sort(F.array_except("p.names", "c.names")).alias("closed_gaps"), F.array_sort(F.array_intersect("p.names", "c.names")).alias("still_open_gaps"),
        F.array_sort(F.array_except("c.names", "p.names")).alias("newly_opened_gaps"),
    )
