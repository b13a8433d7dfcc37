"""Queries of the coverage operators over the test tables, one per operator."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna import config
from lacuna.functions import scoring, text
from lacuna.functions import vectors as vec
from lacuna.operators import clusters, density, embedding, gaps, geometry, kmeans, projection, snapshots
from lacuna.plans import render, reports
from lacuna.runtime import Scratch, shared_folder
from lacuna.sources import cache, files, tables
from lacuna.sources.tables import table

COLUMNS = [
    "sample_id", "filepath", "tags", "ground_truth", "embedding", "embedding_error", "cluster_id", "cluster_label", "cluster_diversity", "cluster_confidence",
    "centroid_distance", "umap_x", "umap_y", "is_outlier",
]
#: The hierarchy's leaves are compared at this similarity: leaf vectors here are means of labelled samples.
LEAF_THRESHOLD = 0.75


def current(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.current_samples(table(spark, folder, "samples"), ["sample_id", *(columns or COLUMNS[1:])])


def unit(spark: SparkSession, folder: str, *columns: str, keep: bool = True) -> DataFrame:
    """Current rows with the unit vector ``v`` instead of the embedding; written once if ``keep``."""
    rows = clusters.embedded(current(spark, folder, "embedding", *columns)).drop("embedding")
    return Scratch(spark).write(rows, "unit") if keep else rows


def r6(name: str):
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


# --- scans, filters, projections


def scan_samples(spark, folder):
    return current(spark, folder, "filepath", "cluster_id", "umap_x", "umap_y").select("sample_id", "filepath", "cluster_id", r6("umap_x"), r6("umap_y"))


def count_samples(spark, folder):
    return current(spark, folder, "embedding").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNotNull()).alias("n_embedded"))


def filter_embedded(spark, folder):
    return current(spark, folder, "embedding").where("embedding IS NOT NULL").select("sample_id", F.size("embedding").cast("long").alias("dim"))


def filter_non_noise(spark, folder):
    return current(spark, folder, "cluster_id").where("cluster_id >= 0")


def filter_embedding_errors(spark, folder):
    return current(spark, folder, "embedding_error").where("embedding_error IS NOT NULL AND embedding_error <> ''")


def filter_tag(spark, folder):
    return current(spark, folder, "tags").where(F.array_contains("tags", "night")).select("sample_id")


def select_by_ids(spark, folder):
    """The current rows of the samples that failed at any time."""
    wanted = table(spark, folder, "samples").where("embedding_error <> ''").select("sample_id")
    return current(spark, folder, "cluster_id").join(wanted, "sample_id", "left_semi")


def sort_by_distance(spark, folder):
    d = F.col("centroid_distance")
    rows = current(spark, folder, "centroid_distance").where(d.between(0.0, 2.0))
    return rows.select("sample_id", r6("centroid_distance")).orderBy(F.desc("centroid_distance"), "sample_id")


def group_by_label(spark, folder):
    return current(spark, folder, "cluster_label").groupBy("cluster_label").agg(F.count(F.lit(1)).alias("n"))


def extract_cluster_data(spark, folder):
    return clusters.clustered(current(spark, folder, "embedding", "cluster_id", "umap_x", "umap_y")).select("sample_id", "cluster_id", r6("umap_x"), r6("umap_y"))


def scatter_points(spark, folder):
    rows = current(spark, folder, "filepath", "cluster_id", "umap_x", "umap_y", "is_outlier")
    rows = rows.where("umap_x IS NOT NULL AND umap_y IS NOT NULL AND cluster_id IS NOT NULL")
    return rows.select(r6("umap_x"), r6("umap_y"), "cluster_id", F.coalesce("is_outlier", F.lit(False)).alias("is_outlier"), text.basename(F.col("filepath")).alias("file"))


def clear_error_field(spark, folder):
    rows = current(spark, folder, "embedding_error")
    return rows.select("sample_id", F.when(F.col("embedding_error") != "", "").otherwise(F.col("embedding_error")).alias("embedding_error"))


def missing_field_audit(spark, folder):
    rows = current(spark, folder)
    fields = ["embedding", "cluster_id", "cluster_label", "cluster_confidence", "centroid_distance", "is_outlier", "umap_x", "umap_y"]
    wide = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields])).alias("f")).select("f.*")


def stratified_sample(spark, folder):
    """Three samples of each ground-truth class, by id."""
    rows = current(spark, folder, "ground_truth").where("ground_truth IS NOT NULL")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("ground_truth").orderBy("sample_id"))).where("_n <= 3").drop("_n")


def max_samples(spark, folder):
    """A fixed random sample of 100 (the operator's feature): the smallest seeded hashes."""
    return current(spark, folder, "cluster_id").orderBy(F.xxhash64("sample_id", F.lit(config.SEED)), "sample_id").limit(100).select("sample_id")


# --- vectors


def embedding_stats(spark, folder):
    rows = current(spark, folder, "embedding").where(vec.usable(F.col("embedding")))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(F.array_min("embedding")), 6).alias("least"), F.round(F.max(F.array_max("embedding")), 6).alias("most"),
        F.round(F.avg(vec.norm(F.col("embedding"))), 6).alias("mean_norm"), F.max(F.size("embedding")).cast("long").alias("dim"),
    )


def l2_normalize(spark, folder):
    rows = unit(spark, folder, keep=False)
    return rows.select("sample_id", F.posexplode("v").alias("pos", "value")).select("sample_id", F.col("pos").cast("long").alias("pos"), r6("value"))


def cosine_distance(spark, folder):
    """Of file hashes in the cache: distance of the first and the last write. As in the SQL, hashes with two usable rows of one instant are left out.

    ``cosine_distance_versions`` has all hashes.
    """
    usable = table(spark, folder, "embedding_cache").where(vec.usable(F.col("embedding")))
    ends = usable.groupBy("file_hash").agg(F.min_by("embedding", F.struct("created_at", F.xxhash64("embedding"))).alias("a"), F.max_by("embedding", F.struct("created_at", F.xxhash64("embedding"))).alias("b"), F.countDistinct("created_at").alias("n"), F.count(F.lit(1)).alias("rows"))
    return ends.where("n = rows").select("file_hash", F.round(vec.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def cosine_distance_versions(spark, folder):
    """Of every file hash in the cache: distance of its first and its last write; copies count once, different vectors of one instant go by a hash of their content."""
    usable = table(spark, folder, "embedding_cache").where(vec.usable(F.col("embedding")))
    order = F.struct("created_at", F.xxhash64("embedding"))
    ends = usable.groupBy("file_hash").agg(F.min_by("embedding", order).alias("a"), F.max_by("embedding", order).alias("b"))
    return ends.select("file_hash", F.round(vec.cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def pairwise_similarity_stats(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", vec.l2_normalize(F.col("embedding")).alias("v"))
    s = clusters.pairwise_stats(Scratch(spark).write(rows, "v"), "vec_id")
    return s.select("pairs", r6("mean"), r6("least"), r6("most"))


def core_distances(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", vec.l2_normalize(F.col("embedding")).alias("v"))
    return clusters.core_distances(Scratch(spark).write(rows, "v"), "vec_id", config.MIN_CLUSTER_SIZE).select("vec_id", r6("core_distance"))


def pairwise_similarity_samples(spark, folder):
    """As ``pairwise_similarity_stats``, over the usable current samples."""
    s = clusters.pairwise_stats(unit(spark, folder), "sample_id")
    return s.select("pairs", r6("mean"), r6("least"), r6("most"))


def core_distances_samples(spark, folder):
    """As ``core_distances``, over the usable current samples."""
    return clusters.core_distances(unit(spark, folder), "sample_id", config.MIN_CLUSTER_SIZE).select("sample_id", r6("core_distance"))


def hdbscan_assign(spark, folder):
    return density.hdbscan(unit(spark, folder), "sample_id")


def kmeans_assign(spark, folder):
    return kmeans.kmeans(unit(spark, folder), "sample_id", 10)


def adaptive_k(spark, folder):
    s = current(spark, folder, "ground_truth", "embedding").where("embedding IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ground_truth").alias("n_truth"))
    return s.select("n", "n_truth", scoring.adaptive_k(F.col("n"), F.col("n_truth")).alias("k"))


def project_2d(spark, folder):
    rows = unit(spark, folder)
    return projection.transform(projection.fit(rows), rows).select("sample_id", r6("umap_x"), r6("umap_y"))


def project_categories(spark, folder):
    rows = unit(spark, folder, "ground_truth")
    return projection.transform(projection.fit(rows), leaf_vectors(rows)).select("child", F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))


def should_retrain(spark, folder):
    """Saved: samples first seen before the middle of the deliveries; current: all."""
    rows = table(spark, folder, "samples").where("sample_id IS NOT NULL")
    middle = rows.agg((F.min("updated_at") + (F.max("updated_at") - F.min("updated_at")) / 2).alias("m"))
    saved = rows.crossJoin(F.broadcast(middle)).where("updated_at <= m").select("sample_id")
    return projection.drift(saved, rows.select("sample_id"))


# --- clusters


def cents(rows: DataFrame) -> DataFrame:
    return Scratch(rows.sparkSession).write(clusters.centroids(rows.where("cluster_id >= 0")), "cents")


def centroids(spark, folder):
    rows = unit(spark, folder, "cluster_id", keep=False)
    out = clusters.centroids(rows.where("cluster_id >= 0")).select("cluster_id", "n", F.posexplode("centroid").alias("pos", "value"))
    return out.select("cluster_id", "n", F.col("pos").cast("long").alias("pos"), r6("value"))


def centroid_distance(spark, folder):
    rows = unit(spark, folder, "cluster_id")
    return clusters.distances(rows, cents(rows)).select("sample_id", "cluster_id", r6("distance"))


def kmeans_outliers(spark, folder):
    rows = unit(spark, folder, "cluster_id")
    d = Scratch(spark).write(clusters.distances(rows, cents(rows)).select("sample_id", "cluster_id", "distance"), "d")
    return clusters.outliers(d).select("sample_id", "outlier")


def nearest_centroid_noise(spark, folder):
    rows = unit(spark, folder, "cluster_id")
    near = clusters.nearest_centroid(rows.where("cluster_id = -1").select("sample_id", "v"), cents(rows))
    return near.select("sample_id", "cluster_id", F.round(1.0 - F.col("similarity"), 6).alias("distance"))


def cluster_sizes(spark, folder):
    return clusters.sizes(current(spark, folder, "cluster_id"))


def sparse_clusters(spark, folder):
    return clusters.sparse(current(spark, folder, "cluster_id"))


def cluster_isolation(spark, folder):
    return clusters.isolation(cents(unit(spark, folder, "cluster_id"))).select("cluster_id", r6("isolation"))


def isolated_clusters(spark, folder):
    return clusters.isolated(cents(unit(spark, folder, "cluster_id"))).select("cluster_id", r6("mean_distance"), r6("threshold"))


def centroid_pairs(spark, folder):
    """How far each category's mean vector is from every other's: number, mean, least and greatest distance.

    All pairs are met in blocks; one row per category comes out, not one per pair.
    """
    leaves = Scratch(spark).write(leaf_vectors(unit(spark, folder, "ground_truth")), "leaves")
    d = clusters.distance_summary(leaves, "child")
    return d.select("child", "others", r6("mean_distance"), r6("least"), r6("most"))


def cluster_centroid_pairs(spark, folder):
    """How far each cluster's centroid is from every other's, as ``centroid_pairs`` for categories; no pair comes out."""
    d = clusters.distance_summary(cents(unit(spark, folder, "cluster_id")), "cluster_id", "centroid")
    return d.select("cluster_id", "others", r6("mean_distance"), r6("least"), r6("most"))


def cluster_umap_centers(spark, folder):
    return clusters.centres_2d(clusters.clustered(current(spark, folder, "embedding", "cluster_id", "umap_x", "umap_y"))).select("cluster_id", r6("x"), r6("y"))


def full_breakdown(spark, folder):
    return clusters.full_breakdown(current(spark, folder, "cluster_id", "cluster_label", "cluster_diversity", "centroid_distance"))


def cluster_health(spark, folder):
    s = clusters.sizes(current(spark, folder, "cluster_id")).withColumn("status", scoring.cluster_health(F.col("size"), F.col("cluster_id")))
    return s.withColumn("color", scoring.health_colour(F.col("status")))


def outlier_count(spark, folder):
    return current(spark, folder, "cluster_id").agg(F.count_if(F.col("cluster_id") == -1).alias("n_outliers"))


def cluster_label_map(spark, folder):
    return clusters.label_map(current(spark, folder, "cluster_id", "cluster_label"))


def apply_cluster_labels(spark, folder):
    rows = current(spark, folder, "cluster_id", "cluster_label")
    return clusters.apply_labels(rows, clusters.label_map(rows.where("cluster_id >= 0"))).select("sample_id", "new_label")


def is_generic_label(spark, folder):
    rows = current(spark, folder, "cluster_id", "cluster_label")
    return rows.select("sample_id", scoring.is_generic_label(F.col("cluster_label"), F.col("cluster_id")).alias("generic"))


def tag_sparse(spark, folder):
    rows = current(spark, folder, "cluster_id", "tags")
    return clusters.tag_sparse(rows, clusters.sparse(rows)).select("sample_id", F.array_join(F.array_sort("tags"), ",").alias("tags"), "newly")


def representatives(spark, folder):
    return clusters.representatives(_with_distance(spark, folder), random=0)


def representatives_random(spark, folder):
    return clusters.representatives(_with_distance(spark, folder))


def _with_distance(spark, folder):
    """Current rows with the stored distance, where it is valid."""
    rows = current(spark, folder, "cluster_id", "centroid_distance").where(F.col("centroid_distance").between(0.0, 2.0))
    return rows.withColumn("distance", F.col("centroid_distance") + 0.0)


def representatives_v1(spark, folder):
    """The two nearest of each cluster, noise included."""
    return clusters.ranked_by_distance(_with_distance(spark, folder).where("cluster_id IS NOT NULL"), 2).select("cluster_id", "sample_id", F.col("rank").cast("long").alias("rank"))


def nearest_rep(spark, folder):
    return clusters.ranked_by_distance(_with_distance(spark, folder).where("cluster_id >= 0"), 1).select("cluster_id", "sample_id")


def lowest_confidence(spark, folder):
    return current(spark, folder, "cluster_confidence").where("cluster_confidence IS NOT NULL").orderBy("cluster_confidence", "sample_id").limit(5).select("sample_id", r6("cluster_confidence"))


def confidence_summary(spark, folder):
    rows = current(spark, folder, "cluster_id", "cluster_confidence").where("cluster_id IS NOT NULL AND cluster_confidence IS NOT NULL")
    c = F.col("cluster_confidence")
    return rows.groupBy((F.col("cluster_id") == -1).alias("noise")).agg(F.round(F.min(c), 6).alias("least"), F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("most"))


def silhouette_exact(spark, folder):
    return clusters.silhouette(unit(spark, folder, "cluster_id")).select("sample_id", "cluster_id", r6("silhouette"))


def crosstab_truth(spark, folder):
    rows = current(spark, folder, "cluster_id", "ground_truth").where("cluster_id IS NOT NULL")
    return rows.groupBy("cluster_id", F.coalesce("ground_truth", F.lit("unknown")).alias("truth")).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(spark, folder):
    return clusters.adjusted_rand(current(spark, folder, "cluster_id", "ground_truth"), "cluster_id", "ground_truth").select("n", r6("ari"))


# --- categories and gaps


def leaf_vectors(rows: DataFrame) -> DataFrame:
    """``(child, v)``: mean unit vector of the samples that carry a category as ground truth."""
    named = rows.withColumn("child", F.lower(text._strip(F.col("ground_truth")))).where("child <> ''")
    return clusters.centroids(named, "child").select("child", F.col("centroid").alias("v"))


def hierarchy(spark, folder):
    return gaps.tidy_hierarchy(table(spark, folder, "category_hierarchy"))


class Analysis:
    """Shared inputs of the gap queries, each written once and only when it is asked for."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.scratch = spark, folder, Scratch(spark)
        self.rows = unit(spark, folder, "cluster_id", "ground_truth", "cluster_label", "umap_x", "umap_y")
        self.cents = cents(self.rows)
        self.samples = current(spark, folder, "cluster_id", "cluster_label")
        self.hierarchy = hierarchy(spark, folder)

    @cached_property
    def leaves(self):
        named = gaps.unique_leaves(self.hierarchy).select("child")
        return self.scratch.write(leaf_vectors(self.rows).join(named, "child", "left_semi"), "leaves")

    @cached_property
    def matched(self):
        return self.scratch.write(gaps.match(self.leaves, self.cents), "matched")

    @cached_property
    def labels(self):
        return self.scratch.write(clusters.label_map(self.samples.where("cluster_id >= 0")), "labels")

    @cached_property
    def isolation(self):
        return self.scratch.write(clusters.isolation(self.cents), "isolation")

    @cached_property
    def records(self):
        return self.scratch.write(gaps.leaf_records(self.hierarchy, self.matched, self.isolation, self.labels, LEAF_THRESHOLD), "records")

    def sparse(self):
        return gaps.sparse_ranked(clusters.sparse(self.samples), self.isolation, self.labels)

    def markers(self):
        """Leaves with samples of their own stand at those samples' mean position."""
        placed = self.rows.where("umap_x IS NOT NULL AND umap_y IS NOT NULL AND NOT isnan(umap_x) AND NOT isnan(umap_y)").withColumn("child", F.lower(text._strip(F.col("ground_truth"))))
        few = placed.where("cluster_id = -1").groupBy("child").agg(F.avg("umap_x").alias("x"), F.avg("umap_y").alias("y"))
        return gaps.marker_positions(self.records.where("is_gap"), few, clusters.centres_2d(placed))

    def gaps(self):
        return self.scratch.write(gaps.all_gaps(gaps.category_gaps(self.records), self.sparse()), "gaps")


def parse_hierarchy(spark, folder):
    """The delivered hierarchy written as one line of text and parsed again."""
    h = table(spark, folder, "category_hierarchy").groupBy("parent_ord").agg(F.min(text._strip(F.col("parent"))).alias("p"), F.array_sort(F.collect_list(F.struct("child_ord", "child"))).alias("c"))
    line = h.orderBy("parent_ord").select(F.concat("p", F.lit(": "), F.array_join(F.transform("c", lambda x: x["child"]), ", ")).alias("g")).collect()
    return gaps.parse_hierarchy(spark, " | ".join(r["g"] for r in line)).select("parent", F.col("parent_ord").cast("long").alias("parent_ord"), "child", F.col("child_ord").cast("long").alias("child_ord"))


def unique_leaves(spark, folder):
    return gaps.unique_leaves(hierarchy(spark, folder))


def category_match(spark, folder):
    return Analysis(spark, folder).matched.select("child", "cluster_id", F.round("sim_raw", 6).alias("similarity"))


def category_match_samples(spark, folder):
    rows = unit(spark, folder, "ground_truth")
    leaves = Scratch(spark).write(leaf_vectors(rows), "leaves")
    return gaps.match_samples(leaves, rows.select("sample_id", "v"), 0.9).select("child", "sample_id", F.round("sim_raw", 6).alias("similarity"), "is_gap")


def gap_priority(spark, folder):
    return Analysis(spark, folder).records.where("is_gap").select("parent_ord", "child", F.round("sim_raw", 6).alias("similarity"), "priority_score")


def gap_priority_weights(spark, folder):
    """Priorities under five settings of the weights."""
    weights = [(0.5, 0.3, 0.2), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.1, 0.8, 0.1)]
    a = Analysis(spark, folder)
    joined = a.matched.join(a.isolation, "cluster_id", "left")
    scored = [F.struct(F.lit(i).alias("setting"), scoring.gap_priority(1.0 - F.col("sim_raw"), F.lit(True), F.coalesce("isolation", F.lit(0.0)), w).alias("priority_score")) for i, w in enumerate(weights)]
    return joined.select("child", F.explode(F.array(*scored)).alias("s")).select("child", "s.*")


def category_rollup(spark, folder):
    return gaps.rollup(Analysis(spark, folder).records)


def category_hierarchy(spark, folder):
    nested = gaps.nested_hierarchy(Analysis(spark, folder).records)
    flat = nested.select("parent", "parent_ord", "coverage", F.explode("children").alias("c"))
    return flat.select("parent", "parent_ord", "coverage", "c.category", "c.similarity", "c.closest_cluster_id", "c.is_gap")


def category_coverage(spark, folder):
    return gaps.category_coverage(Analysis(spark, folder).records)


def category_gaps(spark, folder):
    return gaps.category_gaps(Analysis(spark, folder).records).select("child", "parent", "similarity", "priority_score")


def well_covered(spark, folder):
    return Analysis(spark, folder).records.where("NOT is_gap").select("parent", "child", "similarity", "closest_cluster")


def sparse_clusters_ranked(spark, folder):
    return Analysis(spark, folder).sparse()


def gap_marker_coords(spark, folder):
    return Analysis(spark, folder).markers().select("child", "parent_ord", r6("umap_x"), r6("umap_y"))


def top_gap(spark, folder):
    return reports.top_gap(Analysis(spark, folder).gaps()).select("type", "name", "priority_score")


def priority_gaps(spark, folder):
    ranked = gaps.priority_gaps(Analysis(spark, folder).gaps())
    advice = reports.collection_advice(F.col("type"), F.col("name"), F.col("closest_cluster"), F.col("priority_score"), F.col("count"))
    return ranked.select(F.col("rank").cast("long").alias("rank"), "type", "name", "priority_score", "severity", "target", advice.alias("advice"))


def severity(spark, folder):
    return Analysis(spark, folder).gaps().select("type", "name", "ord", scoring.severity(F.col("priority_score")).alias("severity"))


# --- reports and history


def _score(a: Analysis) -> DataFrame:
    """``coverage_score``: mean of Voronoi and category coverage, or Voronoi alone without categories."""
    v = geometry.voronoi_coverage(a.scratch.write(geometry.points(a.rows), "xy")).select(F.col("coverage").alias("v"))
    both = v.crossJoin(gaps.category_coverage(a.records))
    return both.select(F.round(F.when(F.col("n_leaves") > 0, 0.5 * F.col("v") + 0.5 * F.col("category_coverage")).otherwise(F.col("v")), 4).alias("coverage_score"))


def coverage_score(spark, folder):
    return _score(Analysis(spark, folder))


def executive_totals(spark, folder):
    return reports.totals(current(spark, folder, "cluster_id"))


def _category_score(a: Analysis) -> DataFrame:
    return gaps.category_coverage(a.records).select(F.round("category_coverage", 4).alias("coverage_score"))


def executive_summary(spark, folder):
    a = Analysis(spark, folder)
    return reports.executive_summary(_category_score(a), a.samples, a.gaps())


def recommendation(spark, folder):
    a = Analysis(spark, folder)
    return reports.executive_summary(_category_score(a), a.samples, a.gaps()).select("recommendation")


def history_entry(spark, folder):
    a = Analysis(spark, folder)
    entry = reports.history_entry(_category_score(a), a.samples, a.gaps(), "2024-06-01T00:00:00")
    return entry.select("timestamp", "coverage_score", "n_samples", "n_clusters", "n_sparse_clusters", F.size("gaps").cast("long").alias("n_gaps"))


def _runs(spark, folder):
    h = table(spark, folder, "coverage_history").where("dataset_name IS NOT NULL AND gaps IS NOT NULL")
    body = F.struct("timestamp", "coverage_score", "n_samples", "gaps")
    at = snapshots.instant_micros(F.col("timestamp")).alias("at")
    picked = h.select("dataset_name", at, "timestamp", "coverage_score", "n_samples", "gaps", "delivered_at").groupBy("dataset_name", "at")
    return picked.agg(F.max_by(body, F.struct("delivered_at", F.xxhash64("coverage_score", "gaps"))).alias("s")).select("dataset_name", "at", "s.*")


def history_previous(spark, folder):
    """The run before the last of each dataset."""
    two = reports.last_two_runs(_runs(spark, folder), "dataset_name", [F.desc("at")])
    return two.where("n = 2").select("dataset_name", snapshots.utc_text(F.col("at")).alias("previous_at"), F.round("coverage_score", 4).alias("coverage_score"))


def coverage_diff(spark, folder):
    d = reports.coverage_diff(_runs(spark, folder), "dataset_name", [F.desc("at")])
    joined = [F.array_join(c, "|").alias(c) for c in ("closed_gaps", "still_open_gaps", "newly_opened_gaps")]
    return d.select("dataset_name", F.round("coverage_delta", 4).alias("coverage_delta"), "trend", "new_samples", *joined)


def coverage_quality(spark, folder):
    h = table(spark, folder, "coverage_history").where("coverage_score IS NOT NULL AND NOT isnan(coverage_score)")
    quality = scoring.coverage_quality(F.round(F.col("coverage_score") * 100, 1)).alias("quality")
    return h.groupBy(quality).agg(F.count(F.lit(1)).alias("n"))


def truncate_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.truncate(F.col("text"), 50).alias("short"))


def safe_name(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.safe_name(F.col("author")).alias("dir"))


def combine_labels(spark, folder):
    rows = current(spark, folder, "cluster_id", "ground_truth").where("cluster_id >= 0")
    labels = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_set("ground_truth")).alias("l"))
    return labels.select("cluster_id", text.combine_labels(F.col("l"), F.col("cluster_id")).alias("label"))


def dedup_variations(spark, folder):
    rows = current(spark, folder, "cluster_diversity").where("cluster_diversity IS NOT NULL")
    return rows.select("sample_id", F.array_join(text.dedup_phrases(F.split("cluster_diversity", ";")), "; ").alias("variations"))


def parse_description(spark, folder):
    """Descriptions built from the samples' own labels, in three layouts, and parsed."""
    rows = current(spark, folder, "cluster_id", "cluster_label", "cluster_diversity").where("cluster_label IS NOT NULL")
    said = F.when(F.length("sample_id") % 2 == 0, F.concat(F.lit("COMMON: "), "cluster_label", F.lit("\nVARIATION: "), F.coalesce("cluster_diversity", F.lit("")))).otherwise(F.col("cluster_label"))

    @F.pandas_udf("common string, variation string")
    def parsed(s):
        import pandas as pd

        return pd.DataFrame([text.parse_description(t) for t in s], columns=["common", "variation"])

    return rows.select("sample_id", parsed(said).alias("p")).select("sample_id", "p.*")


def cluster_csv(spark, folder):
    b = clusters.full_breakdown(current(spark, folder, "cluster_id", "cluster_label", "cluster_diversity", "centroid_distance"))
    return b.select("cluster_id", "size", "status", "mean_centroid_distance", "max_centroid_distance", "cluster_label", "cluster_diversity").orderBy("cluster_id")


def csv_base64(spark, folder):
    csv = render.cluster_csv(cluster_csv(spark, folder))
    return spark.createDataFrame([(render.csv_link(csv),)], "link string")


def marker_sizes(spark, folder):
    rows = current(spark, folder, "cluster_id", "centroid_distance").where(F.col("cluster_id") >= 0).where(F.col("centroid_distance").between(0.0, 2.0))
    return geometry.marker_size(rows).select("sample_id", r6("marker"))


def svg_coords(spark, folder):
    rows = current(spark, folder, "umap_x", "umap_y").where("umap_x IS NOT NULL AND umap_y IS NOT NULL AND NOT isnan(umap_x) AND NOT isnan(umap_y)")
    return geometry.svg_position(rows).select("sample_id", r6("sx"), r6("sy"))


# --- geometry


def _xy(spark, folder):
    return Scratch(spark).write(geometry.points(current(spark, folder, "umap_x", "umap_y")), "xy")


def grid_coverage(spark, folder):
    return geometry.grid_coverage(_xy(spark, folder)).select("cells", r6("coverage"))


def kde_grid(spark, folder):
    return geometry.kde_grid(_xy(spark, folder)).select("i", "j", r6("density"))


def polygon_area(spark, folder):
    """Area of the quadrilateral of extreme points of each cluster: left, bottom, right, top."""
    rows = clusters.clustered(current(spark, folder, "embedding", "cluster_id", "umap_x", "umap_y")).where("cluster_id >= 0")
    p = F.struct(F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))
    ends = rows.groupBy("cluster_id").agg(
        F.min_by(p, F.struct("umap_x", "sample_id")).alias("a"), F.min_by(p, F.struct("umap_y", "sample_id")).alias("b"),
        F.max_by(p, F.struct("umap_x", "sample_id")).alias("c"), F.max_by(p, F.struct("umap_y", "sample_id")).alias("d"),
    )
    return ends.select("cluster_id", F.round(geometry.polygon_area(F.array("a", "b", "c", "d")), 6).alias("area"))


def convex_hull(spark, folder):
    return geometry.convex_hull(_xy(spark, folder))


def voronoi_coverage(spark, folder):
    return geometry.voronoi_coverage(_xy(spark, folder)).select("cells", r6("hull_area"), r6("coverage"))


# --- ingestion


def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.content_hash(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), config.HASH_BYTES).alias("file_hash"))


def _entries(spark, folder):
    """Entries of the batches as samples to embed: by hash as delivered."""
    b = table(spark, folder, "embedding_batches").groupBy("entry_id").agg(F.min("file_hash").alias("file_hash"))
    return b.select("entry_id", F.lower(F.trim("file_hash")).alias("file_hash"))


def cache_lookup(spark, folder):
    hits = cache.lookup(_entries(spark, folder), table(spark, folder, "embedding_cache"))
    return hits.select("entry_id", F.col("cached").isNotNull().alias("hit"), F.round(vec.norm(F.col("cached")), 4).alias("norm"))


def cache_misses(spark, folder):
    return cache.misses(_entries(spark, folder), table(spark, folder, "embedding_cache")).select("entry_id")


def cache_upsert(spark, folder):
    names = ["file_hash", "embedding", "dim", "dtype", "created_at"]
    new = table(spark, folder, "embedding_batches").select(*names)
    return cache.upsert(table(spark, folder, "embedding_cache").select(*names), new).select("file_hash", r6("created_at"))


def cache_stats(spark, folder):
    c = cache.compact(table(spark, folder, "embedding_cache"))
    return c.agg(F.count(F.lit(1)).alias("entries"), F.sum(4 * F.coalesce(F.when(F.size("embedding") >= 0, F.size("embedding")), F.lit(0)).cast("long")).alias("vector_bytes"))


def embed_status(spark, folder):
    rows = current(spark, folder, "embedding", "filepath").withColumn("file_hash", F.sha2(F.coalesce("filepath", F.lit("")), 256))
    return embedding.status(rows, table(spark, folder, "embedding_cache")).select("sample_id", "status")


def embed_status_counts(spark, folder):
    return embedding.status_counts(embed_status(spark, folder))


def embed_run(spark, folder):
    """Documents embedded by the offline provider, the cache of all history first; states and failures per row."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("content"), F.lit(None).cast("array<double>").alias("embedding"))
    rows = docs.withColumn("file_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("embedding_error", F.lit(None).cast("string"))
    done, _ = embedding.embed_all(rows, table(spark, folder, "embedding_cache"), embedding.HashingProvider(), Scratch(spark), first_wait=0.0)
    return done.select("sample_id", "status", "embedding_error")


def failure_reasons_top(spark, folder):
    return embedding.failure_reasons(current(spark, folder, "embedding_error"))


def rate_limit_flag(spark, folder):
    rows = table(spark, folder, "samples").where("embedding_error IS NOT NULL").groupBy("embedding_error").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("rate_limited", scoring.is_rate_limit(F.col("embedding_error")))


def embed_categories(spark, folder):
    leaves = gaps.unique_leaves(hierarchy(spark, folder))
    return embedding.embed_categories(leaves, embedding.HashingProvider()).select("child", F.size("v").alias("dim"))


def scan_binary_dir(spark, folder):
    """The files of the table folder with the hashes of their first bytes."""
    return files.hash_files(spark, folder, "*.parquet").select(text.basename(F.col("filepath")).alias("file"), "file_hash")


def timing_summary(spark, folder):
    """Durations between the deliveries of each dataset's consecutive snapshots, in seconds, with what 100 would take."""
    runs = table(spark, folder, "coverage_history").where("dataset_name IS NOT NULL AND delivered_at IS NOT NULL")
    gap = runs.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"), (F.unix_micros(F.max("delivered_at").cast("timestamp")) - F.unix_micros(F.min("delivered_at").cast("timestamp"))).alias("us"))
    per = gap.where("n > 1").withColumn("s", F.col("us") / 1e6 / (F.col("n") - 1))
    return per.agg(F.round(F.sum("s"), 3).alias("total"), F.round(F.avg("s"), 3).alias("mean"), F.round(F.min("s"), 3).alias("least"), F.round(F.max("s"), 3).alias("most"), F.round(F.avg("s") * 100, 3).alias("for_100"))


# --- whole runs


def gap_report_row(spark, folder):
    """The nested report of a run as one row, as JSON."""
    a = Analysis(spark, folder)
    nested = gaps.nested_hierarchy(a.records).agg(F.array_sort(F.collect_list(F.struct("parent_ord", "parent", "n_children", "n_covered", "coverage", "best_similarity", "children"))).alias("category_hierarchy"))
    listed = gaps.category_gaps(a.records).agg(F.collect_list(F.struct("child", "priority_score", "similarity", "closest_cluster")).alias("category_gaps"))
    sparse = a.sparse().agg(F.collect_list(F.struct("cluster_id", "label", "count", "priority_score")).alias("sparse_clusters"))
    row = sparse.crossJoin(listed).crossJoin(nested).crossJoin(_score(a))
    return row.select(F.to_json(F.struct("*")).alias("report"))


def export_summary(spark, folder):
    """Writes the HTML export of a run to the shared folder and says what was written."""
    from lacuna.plans import api

    report = api.report_of(Analysis(spark, folder), "samples", _score)
    path = f"{shared_folder(spark)}/coverage.html".removeprefix("file://")
    return spark.createDataFrame([api.export_report(report, path)], "output_path string, size_bytes long, n_samples long, n_clusters long, csv_rows long")


NOT_QUERIES = {"current", "unit", "r6", "cents", "leaf_vectors", "hierarchy", "table", "shared_folder"}
QUERIES = {
    name: f for name, f in list(globals().items()) if callable(f) and not isinstance(f, type) and getattr(f, "__module__", "") == __name__ and name[0] != "_" and name not in NOT_QUERIES
}
