"""Whole runs: analyse a table of samples, store the report, show it, export it, feed a panel."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna import config
from lacuna.functions import scoring, text
from lacuna.operators import clusters, density, embedding, gaps, geometry, kmeans, projection
from lacuna.plans import render, reports
from lacuna.runtime import Scratch
from lacuna.sources import tables

#: Columns that a run writes; what a table brings under these names is written anew.
WRITTEN = ["cluster_id", "cluster_confidence", "distance", "centroid_distance", "is_outlier", "umap_x", "umap_y", "cluster_diversity", "status", "v"]


class EmptyDataset(ValueError):
    pass


class NothingEmbedded(ValueError):
    pass


@dataclass
class Run:
    """What one analysis leaves: tables, each written, and the score."""

    name: str
    scratch: Scratch
    rows: DataFrame  # sample_id, v, cluster_id, cluster_confidence, distance, is_outlier, umap_x, umap_y, cluster_label
    samples: DataFrame
    records: DataFrame
    sparse_clusters: DataFrame
    score: DataFrame
    labels: DataFrame
    extra: dict = field(default_factory=dict)

    def gaps(self) -> DataFrame:
        return gaps.all_gaps(gaps.category_gaps(self.records), self.sparse_clusters)


def analyze(
    samples: DataFrame,
    cfg: config.AnalysisConfig,
    name: str = "dataset",
    provider: embedding.Provider | None = None,
    cache: DataFrame | None = None,
    content: str = "content",
    describers: Sequence[Callable[[str], str]] = (),
    categories: DataFrame | None = None,
    model: projection.PCAModel | None = None,
    known_ids: DataFrame | None = None,
) -> Run:
    """Embed, cluster, project, label, find gaps.

    ``samples`` needs ``sample_id``; ``embedding`` (or ``content`` with a provider, cached by content
    hash), ``tags``, ``cluster_label`` are used where present. Other columns are ignored. ``clear_cache`` forgets
    all stored vectors and the cache first. ``describe`` asks ``describers`` (picklable; the next one where
    one fails) for representatives of every cluster; labels and ``cluster_diversity`` come from the answers.
    Expected categories need vectors of the samples' own model: from ``provider``, or ``categories`` (child, v). A
    ``model`` of an earlier run over ``known_ids`` (sample_id) is used again unless too many samples are new.
    """
    if cfg.expected_categories.strip() and provider is None and categories is None:
        raise ValueError("expected categories need a provider or vectors of the samples' own model")
    if cfg.describe and not describers:
        raise ValueError("descriptions need a describer")
    spark = samples.sparkSession
    scratch = Scratch(spark)
    if not samples.limit(1).count():
        raise EmptyDataset("no samples")
    if cfg.max_samples:
        samples = samples.orderBy(F.xxhash64("sample_id", F.lit(config.SEED)), "sample_id").limit(cfg.max_samples)
    base = samples.drop(*WRITTEN)
    for column, kind in (("embedding", "array<double>"), ("embedding_error", "string"), ("cluster_label", "string"), ("tags", "array<string>")):
        if column not in base.columns:
            base = base.withColumn(column, F.lit(None).cast(kind))
    entries = None
    if cfg.clear_cache:
        base, cache = base.withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("embedding_error", F.lit(None).cast("string")), None
    if provider is not None and content in base.columns:
        base = base.withColumn("file_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
        known = cache if cache is not None else spark.createDataFrame([], "file_hash string, embedding array<float>, dim int, dtype string, created_at double")
        base, entries = embedding.embed_all(base, known, provider, scratch, content, first_wait=0.0)
    base = scratch.write(base, "samples")
    unit = scratch.write(clusters.embedded(base, cfg.dim).select("sample_id", "v", "cluster_label"), "unit")
    n = unit.count()
    if not n:
        raise NothingEmbedded("no sample has an embedding")
    wanted = 1 if n < 3 else cfg.n_clusters
    if wanted > 0:
        found = kmeans.kmeans(unit, "sample_id", wanted).withColumn("cluster_confidence", F.lit(1.0))
    else:
        found = density.hdbscan(unit, "sample_id")
    assigned = scratch.write(unit.join(found, "sample_id"), "assigned")
    cents = scratch.write(clusters.centroids(assigned.where("cluster_id >= 0"), dim=cfg.dim), "cents")
    own = clusters.distances(assigned.where("cluster_id >= 0"), cents).select("sample_id", "distance")
    noise = clusters.nearest_centroid(assigned.where("cluster_id = -1").select("sample_id", "v"), cents).select("sample_id", (1.0 - F.col("similarity")).alias("distance"))
    measured = assigned.join(own.unionByName(noise), "sample_id", "left")
    if wanted > 0:
        measured = clusters.outliers(measured).withColumnRenamed("outlier", "is_outlier")
    else:
        measured = measured.withColumn("is_outlier", F.col("cluster_id") == config.NOISE)
    if model is None or known_ids is None or projection.drift(known_ids, unit.select("sample_id")).first()["retrain"]:
        model = projection.fit(unit)
    rows = scratch.write(projection.transform(model, measured), "rows")
    plain = clusters.label_map(rows.where("cluster_id >= 0")) if cfg.preserve_labels else rows.where("cluster_id >= 0").select("cluster_id").distinct().select(
        "cluster_id", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")).alias("label")
    )
    if cfg.describe:
        described = scratch.write(descriptions(clusters.representatives(rows), describers), "described")
        plain = plain.join(described.select("cluster_id", F.col("label").alias("_own")), "cluster_id", "left").select("cluster_id", F.coalesce("_own", "label").alias("label"))
    labels = scratch.write(plain, "labels")
    rows = scratch.write(clusters.apply_labels(rows, labels).drop("cluster_label").withColumnRenamed("new_label", "cluster_label"), "labelled")
    isolation = scratch.write(clusters.isolation(cents), "isolation")
    tree = scratch.write(gaps.parse_hierarchy(spark, cfg.expected_categories), "hierarchy")
    leaves = gaps.unique_leaves(tree).select("child")
    embedded = embedding.embed_categories(leaves, provider) if categories is None and provider is not None else (categories if categories is not None else leaves.where("false").withColumn("v", F.array().cast("array<double>"))).join(leaves, "child", "left_semi")
    vectors = scratch.write(embedded.where(F.size("v") == cfg.dim), "leaves")
    matched = scratch.write(gaps.match(vectors, cents), "matched")
    records = scratch.write(gaps.leaf_records(tree, matched, isolation, labels, cfg.gap_threshold, cfg.weights), "records")
    sparse = scratch.write(gaps.sparse_ranked(clusters.sparse(rows), isolation, labels, cfg.weights), "sparse")
    area = geometry.voronoi_coverage(geometry.points(rows)).select(F.col("coverage").alias("v"))
    both = area.crossJoin(gaps.category_coverage(records))
    score = scratch.write(both.select(F.round(F.when(F.col("n_leaves") > 0, 0.5 * F.col("v") + 0.5 * F.col("category_coverage")).otherwise(F.col("v")), 4).alias("coverage_score")), "score")
    all_rows = base.drop("cluster_label").join(rows.select("sample_id", "cluster_id", "cluster_confidence", "distance", "is_outlier", "umap_x", "umap_y", "cluster_label"), "sample_id", "left")
    tagged = clusters.tag_sparse(all_rows.withColumnRenamed("distance", "centroid_distance"), sparse).drop("newly")
    if cfg.describe:
        tagged = tagged.join(described.select("cluster_id", F.col("diversity").alias("cluster_diversity")), "cluster_id", "left").select(*tagged.columns, "cluster_diversity")
    else:
        tagged = tagged.withColumn("cluster_diversity", F.lit(None).cast("string"))
    done = scratch.write(tagged, "tagged")
    markers = gaps.marker_positions(gaps.category_gaps(records).join(matched.select("child", F.col("cluster_id").alias("closest_cluster_id")), "child"), projection.transform(model, vectors).select("child", F.col("umap_x").alias("x"), F.col("umap_y").alias("y")), clusters.centres_2d(rows))
    return Run(name, scratch, rows, done, records, sparse, score, labels, {"model": model, "cache_entries": entries, "markers": markers, "centroids": cents})


def descriptions(representatives: DataFrame, describers: Sequence[Callable[[str], str]]) -> DataFrame:
    """``(cluster_id, label, diversity)`` of described representatives (cluster_id, sample_id, role).

    Every representative is described once, on the executors, by the first describer that answers. The label joins the
    first two different common parts, diversity all different variations; a cluster without answers has neither.
    """
    order = F.when(F.col("role") == "nearest", 0).when(F.col("role") == "boundary", 1).otherwise(2)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for i in b["sample_id"]:
                answer = None
                for describe in describers:
                    try:
                        answer = describe(i)
                    except Exception:  # the next one may know it; what none knows stays without
                        continue
                    if answer:
                        break
                found.append(text.parse_description(answer) if answer else (None, None))
            yield pd.DataFrame({"cluster_id": b["cluster_id"], "sample_id": b["sample_id"], "o": b["o"], "common": [c for c, _ in found], "variation": [v for _, v in found]})

    asked = representatives.select("cluster_id", "sample_id", order.alias("o")).repartition("cluster_id", "sample_id")
    kind = representatives.schema["sample_id"].dataType.simpleString()
    answers = asked.mapInPandas(ask, f"cluster_id int, sample_id {kind}, o int, common string, variation string")
    listed = answers.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("o", "sample_id", "common", "variation"))).alias("a"))  # four at most
    parts = {c: F.array_distinct(F.filter(F.col(f"a.{c}"), lambda x: F.coalesce(x, F.lit("")) != "")) for c in ("common", "variation")}
    label = F.when(F.size(parts["common"]) > 0, text.combine_labels(parts["common"], F.col("cluster_id")))
    return listed.select("cluster_id", label.alias("label"), F.nullif(F.array_join(parts["variation"], "; "), F.lit("")).alias("diversity"))


def history_of(run: Run) -> DataFrame:
    return reports.history_entry(run.score, run.samples, run.gaps(), datetime.now(timezone.utc).isoformat(timespec="seconds"))


def append_history(run: Run, path: str) -> None:
    """Appends the run to a history table; the difference of the last two is ``last_diff``."""
    history_of(run).withColumn("dataset_name", F.lit(run.name)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def last_diff(spark, path: str, name: str) -> dict | None:
    """The difference between the last two runs of a dataset, or None."""
    history = spark.read.parquet(path).where(F.col("dataset_name") == name)
    row = reports.coverage_diff(history, "dataset_name", [F.desc("at")]).first()
    return row.asDict() if row else None


def show_report(run: Run, diff: dict | None = None) -> dict:
    """The three tiers as Python values, and as Markdown under ``markdown``."""
    report = _collect(run.score, run.samples, run.gaps(), run.records, diff)
    return report | {"markdown": render.markdown(report)}


def _collect(score: DataFrame, samples: DataFrame, all_gaps: DataFrame, records: DataFrame, diff: dict | None) -> dict:
    ranked = gaps.priority_gaps(all_gaps)
    advice = reports.collection_advice(F.col("type"), F.col("name"), F.col("closest_cluster"), F.col("priority_score"), F.col("count"))
    as_dicts = lambda df: [r.asDict() for r in df.collect()]
    return {
        "summary": reports.executive_summary(score, samples, all_gaps).first().asDict(),
        "priority_gaps": as_dicts(ranked.withColumn("advice", advice).orderBy("rank")),
        "clusters": as_dicts(clusters.full_breakdown(samples).orderBy("cluster_id")),
        "n_outliers": samples.where("cluster_id = -1").count(),
        "well_covered": as_dicts(records.where("NOT is_gap").select("parent", "child", "similarity", "closest_cluster").orderBy("parent_ord", "child_ord")),
        "diff": diff,
        "points": [],
        "markers": [],
    }


def report_of(analysis, name: str, score: Callable) -> dict:
    """A report of the shared inputs of the queries."""
    columns = ["filepath", "cluster_id", "cluster_label", "cluster_diversity", "centroid_distance", "is_outlier", "umap_x", "umap_y"]
    samples = analysis.scratch.write(tables.current_samples(tables.table(analysis.spark, analysis.folder, "samples"), ["sample_id", *columns]), "reported")
    report = _collect(score(analysis), samples, analysis.gaps(), analysis.records, None) | {"name": name}
    rows = samples.where("cluster_id IS NOT NULL").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False))).withColumn("file", text.basename(F.col("filepath")))
    return place(report, rows, analysis.markers())


def export_report(report: dict, path: str) -> dict:
    """Writes the page to ``path`` (``.html`` is added where missing; folders are made) and says what was written."""
    if not path.strip():
        raise ValueError("a path is required")
    path = os.path.abspath(os.path.expanduser(path if path.lower().endswith(".html") else path + ".html"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:  # piece by piece: the page of a large map is never held whole
        for piece in render.html_parts(report.get("name", "dataset"), report, datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")):
            f.write(piece.encode("utf-8"))
        size = f.tell()
    one = report["summary"]
    return {"output_path": path, "size_bytes": size, "n_samples": one["n_samples"], "n_clusters": one["n_clusters"], "csv_rows": len(report["clusters"])}


def draw(run: Run, report: dict) -> dict:
    """``report`` with drawing positions of all points and gap markers."""
    return place(report, run.rows.withColumn("file", F.col("sample_id")), run.extra["markers"])


class Points:
    """Placed rows in order of their ids; they come to the driver partition by partition whenever they are looked through."""

    def __init__(self, placed: DataFrame):
        self.placed = placed

    def __len__(self) -> int:
        return self.placed.count()

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.placed.orderBy("sample_id").toLocalIterator())

    def clusters(self) -> list[int]:
        return sorted(r[0] for r in self.placed.where("cluster_id >= 0").select("cluster_id").distinct().collect())


def place(report: dict, rows: DataFrame, markers: DataFrame) -> dict:
    """``report`` with the drawing positions of all rows that have a finite one, in order of their ids, and of the markers."""
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf')" for c in ("umap_x", "umap_y")))
    placed = geometry.svg_position(rows).select("sample_id", "sx", "sy", "cluster_id", "is_outlier", "file")
    marks = markers.select(F.col("child").alias("name"), "umap_x", "umap_y")
    range_ = rows.agg(*[f(c).alias(f"{n}{c[-1]}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("umap_x", "umap_y")]).first()
    left, right, top, bottom = geometry.MARGINS
    w, h = geometry.DRAWING[0] - left - right, geometry.DRAWING[1] - top - bottom
    def at(v, lo, hi, size):
        return size / 2 if lo is None or hi <= lo else min(1.0, max(0.0, (v - lo) / (hi - lo))) * size

    gaps_ = [{"name": m["name"], "sx": left + at(m["umap_x"], range_["lox"], range_["hix"], w), "sy": top + h - at(m["umap_y"], range_["loy"], range_["hiy"], h)} for m in marks.collect()]
    return report | {"points": Points(placed), "markers": gaps_}


def panel_payload(run: Run) -> dict:
    """What a map panel needs: density grid, traces per cluster, noise, gap markers, score and summary."""
    report = draw(run, show_report(run))
    density_grid = geometry.kde_grid(geometry.points(run.rows)).orderBy("i", "j").collect()
    health = {c["cluster_id"]: c["status"] for c in report["clusters"]}
    traces: dict[int, dict] = {}
    for p in report["points"]:
        t = traces.setdefault(p["cluster_id"], {"x": [], "y": [], "ids": [], "color": config.HEALTH_COLOURS[health.get(p["cluster_id"], "noise")]})
        t["x"].append(p["sx"])
        t["y"].append(p["sy"])
        t["ids"].append(p["sample_id"])
    return {"density": [r["density"] for r in density_grid], "traces": traces, "gaps": report["markers"], "score": report["summary"]["coverage_score"], "markdown": report["markdown"]}


def describe_cluster(run: Run, cluster_id: int, describe: Callable[[str], str], session: dict) -> dict:
    """The description of one cluster, fetched once per session.

    Noise has none; an earlier answer is used again unless it failed; a label of its own counts as known;
    else the nearest representative is described. A failure is kept and tried again on the next call.
    """
    if cluster_id == config.NOISE:
        return session.setdefault(cluster_id, {"source": "noise"})
    if cluster_id in session and session[cluster_id]["source"] != "error":
        return session[cluster_id]
    label = run.labels.where(F.col("cluster_id") == cluster_id).select("label", scoring.is_generic_label(F.col("label"), F.col("cluster_id")).alias("generic")).first()
    if label is not None and not label["generic"]:
        session[cluster_id] = {"source": "upfront", "label": label["label"]}
        return session[cluster_id]
    first = clusters.ranked_by_distance(run.rows.where(F.col("cluster_id") == cluster_id), 1).first()
    try:
        common, variation = text.parse_description(describe(first["sample_id"]))
        session[cluster_id] = {"source": "lazy", "label": common, "variation": variation}
    except Exception as e:
        session[cluster_id] = {"source": "error", "error": f"{type(e).__name__}: {e}"}
    return session[cluster_id]


__all__ = ["EmptyDataset", "NothingEmbedded", "Run", "analyze", "append_history", "describe_cluster", "draw", "export_report", "history_of", "last_diff", "panel_payload", "report_of", "show_report"]
