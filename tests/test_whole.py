"""The queries do the whole job: every usable sample, every restart, every cluster, every hash, every point."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lacuna.operators import blocks, clusters, density
from lacuna.plans import coverage_queries

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def unit_rows(n, groups, seed, dim=64):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dim))[rng.integers(0, groups, n)] + rng.uniform(0.05, 0.6, (n, 1)) * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, m):
    return spark.createDataFrame([(f"s{i:04d}", [float(x) for x in v]) for i, v in enumerate(m)], "sample_id string, v array<double>")


@needs_tables
def test_clustering_covers_all_usable_samples(spark):
    want = {r[0] for r in coverage_queries.unit(spark, FOLDER).select("sample_id").collect()}
    for name in ("hdbscan_assign", "kmeans_assign", "core_distances_samples"):
        assert {r["sample_id"] for r in entry.queries()[name](spark, FOLDER).collect()} == want
    assert entry.queries()["pairwise_similarity_samples"](spark, FOLDER).first()["pairs"] == len(want) * (len(want) - 1)


@pytest.mark.parametrize("n, groups", [(300, 8), (900, 90), (400, 2)])
def test_spanning_tree_weighs_the_same_as_by_brute_force(spark, n, groups):
    x = unit_rows(n, groups, n)
    x[:20] = x[100:120]  # copies
    d = np.clip(1 - x @ x.T, 0, 2)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, 3]
    m = np.maximum(np.maximum(d, core), core[:, None])
    reached, near = np.zeros(n, bool), m[0].copy()  # Prim
    reached[0], want = True, []
    for _ in range(n - 1):
        j = np.where(reached, np.inf, near).argmin()
        want.append(near[j])
        reached[j] = True
        near = np.minimum(near, m[j])
    got = density.spanning_tree(spark, x, 3, listed=4)
    assert np.allclose([e[2] for e in got], np.sort(want), atol=1e-12)
    assert all(np.isclose(m[i, j], w, atol=1e-12) for i, j, w in got)


def test_summaries_do_not_depend_on_chunks_and_blocks(spark, monkeypatch):
    x = unit_rows(200, 5, 1)
    rows, s = frame(spark, x), x @ x.T
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 700)
    monkeypatch.setattr(blocks.chunks, "__defaults__", (64,))
    off = s[~np.eye(200, dtype=bool)]
    assert np.allclose(list(clusters.pairwise_stats(rows, "sample_id").first()), [off.size, off.mean(), off.min(), off.max()])
    core = [r[1] for r in clusters.core_distances(rows, "sample_id", 3).orderBy("sample_id").collect()]
    np.fill_diagonal(s, 2.0)
    assert np.allclose(core, np.sort(1 - s, axis=1)[:, 3])


@pytest.mark.parametrize("rows", [60, 1_000_001])
def test_kmeans_keeps_all_restarts_at_every_size(spark, monkeypatch, rows):
    from lacuna.operators import kmeans

    seeds, data = [], frame(spark, unit_rows(60, 3, 2))

    class Model:
        def __init__(self, seed):
            self.summary = type("Summary", (), {"trainingCost": float(seed != 47)})()
            self.seed = seed

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.seed))

    class Counted:
        def __init__(self, k, seed, maxIter):
            self.seed = seed

        def fit(self, df):
            seeds.append(self.seed)
            return Model(self.seed)

    monkeypatch.setattr(kmeans, "KMeans", Counted)
    monkeypatch.setattr(type(data), "count", lambda self: rows)
    got = kmeans.kmeans(data, "sample_id", 3)
    assert seeds == list(range(42, 52)) and got.first()["cluster_id"] == 47


def test_kmeans_query_takes_the_default_restarts(spark, monkeypatch):
    from lacuna import config
    from lacuna.operators import kmeans

    asked = {}
    monkeypatch.setattr(coverage_queries, "unit", lambda *a: None)
    monkeypatch.setattr(kmeans, "kmeans", lambda rows, id_, k, runs=config.KMEANS_RUNS: asked.update(runs=runs))
    coverage_queries.kmeans_assign(spark, FOLDER)
    assert asked["runs"] == config.KMEANS_RUNS


@needs_tables
def test_every_cluster_centroid_meets_every_other(spark):
    found = clusters.centroids(coverage_queries.unit(spark, FOLDER, "cluster_id").where("cluster_id >= 0")).collect()
    m = np.array([r["centroid"] for r in found])
    d = np.clip(1 - m @ m.T, 0, 2)
    got = {r["cluster_id"]: r for r in entry.queries()["cluster_centroid_pairs"](spark, FOLDER).collect()}
    assert set(got) == {r["cluster_id"] for r in found} and len(found) > 2
    for i, r in enumerate(found):
        rest, g = np.delete(d[i], i), got[r["cluster_id"]]
        assert g["others"] == len(rest)
        assert np.allclose([g["mean_distance"], g["least"], g["most"]], [rest.mean(), rest.min(), rest.max()], atol=2e-6)


def test_distances_of_versions_keep_hashes_with_copies(spark, tmp_path):
    a, b = [1.0] + [0.0] * 63, [0.0, 2.0] + [0.0] * 62
    rows = [("one", a, 1.0), ("one", a, 1.0), ("two", a, 1.0), ("two", a, 1.0), ("two", b, 2.0), ("two", b, 2.0), ("tie", a, 1.0), ("tie", b, 1.0), ("bad", [1.0], 1.0)]
    spark.createDataFrame(rows, "file_hash string, embedding array<float>, created_at double").write.parquet(str(tmp_path / "embedding_cache.parquet"))
    got = {r[0]: r[1] for r in entry.queries()["cosine_distance_versions"](spark, str(tmp_path)).collect()}
    assert got == {"one": 0.0, "two": 1.0, "tie": 1.0}


@needs_tables
def test_export_has_distances_diversity_and_all_points(spark):
    from lacuna.plans import api

    report = api.report_of(coverage_queries.Analysis(spark, FOLDER), "samples", coverage_queries._score)
    want = {r["cluster_id"]: r.asDict() for r in entry.queries()["full_breakdown"](spark, FOLDER).collect()}
    assert {c["cluster_id"]: c for c in report["clusters"]} == want
    assert any(c["mean_centroid_distance"] is not None for c in report["clusters"]) and any(c["cluster_diversity"] for c in report["clusters"])
    shown = coverage_queries.scatter_points(spark, FOLDER).where("NOT isnan(umap_x) AND NOT isnan(umap_y) AND abs(umap_x) < double('inf') AND abs(umap_y) < double('inf')")
    assert len(report["points"]) == shown.count() > 0
    assert len(report["markers"]) == entry.queries()["gap_marker_coords"](spark, FOLDER).count()


def test_drawing_has_no_cap(spark):
    from lacuna.plans import api

    rows = spark.range(5500).selectExpr("cast(id AS string) AS sample_id", "double(id) AS umap_x", "double(-id) AS umap_y", "int(id % 7) AS cluster_id", "false AS is_outlier", "'f' AS file")
    marks = spark.createDataFrame([("gap", 5499.0, -5499.0)], "child string, umap_x double, umap_y double")
    got = api.place({}, rows, marks)
    last = next(p for p in got["points"] if p["sample_id"] == "5499")
    assert len(got["points"]) == 5500 and np.allclose([got["markers"][0]["sx"], got["markers"][0]["sy"]], [last["sx"], last["sy"]])


def test_density_has_no_bound_of_rows_and_does_not_depend_on_chunks(spark, monkeypatch):
    x = unit_rows(700, 40, 4)
    whole = [tuple(r) for r in density.hdbscan(frame(spark, x), "sample_id").orderBy("sample_id").collect()]
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 300)
    monkeypatch.setattr(density, "MAX_ROWS", 600, raising=False)
    assert [tuple(r) for r in density.hdbscan(frame(spark, x), "sample_id").orderBy("sample_id").collect()] == whole
    assert len({r[1] for r in whole}) > 5


def test_export_holds_no_points_and_writes_the_same_page(spark, tmp_path):
    from lacuna.plans import api, render

    report = api.report_of(coverage_queries.Analysis(spark, FOLDER), "samples", coverage_queries._score)
    assert not isinstance(report["points"], list)
    done = api.export_report(report, str(tmp_path / "page"))
    text = (tmp_path / "page.html").read_text(encoding="utf-8")
    assert done["size_bytes"] == (tmp_path / "page.html").stat().st_size
    assert render.svg(list(report["points"]), report["markers"]) in text and text.count("<circle") == len(report["points"])


@pytest.mark.parametrize("n, groups", [(1500, 12), (600, 600), (3, 1), (900, 2)])
def test_pairs_left_out_change_nothing(spark, monkeypatch, n, groups):
    from lacuna.operators import balls

    x = unit_rows(n, groups, n)
    if n > 500:
        x[:20], x[20] = x[100:120], 0.0  # copies, and a vector without direction
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 400)
    monkeypatch.setattr(balls, "BLOCK", 100)
    monkeypatch.setattr(balls, "LARGE", 10)
    rows, s = frame(spark, x), x @ x.T
    off = s[~np.eye(n, dtype=bool)]
    assert np.allclose(list(clusters.pairwise_stats(rows, "sample_id").first()), [off.size, off.mean(), off.min(), off.max()], atol=1e-12)
    core = [r[1] for r in clusters.core_distances(rows, "sample_id", 3).orderBy("sample_id").collect()]
    np.fill_diagonal(s, -np.inf)
    assert np.allclose(core, np.clip(1 - np.sort(s, axis=1)[:, -min(3, n - 1)], 0, 2), atol=1e-12)


def test_most_pairs_of_groups_are_not_met(spark, monkeypatch):
    from lacuna.operators import balls

    x = unit_rows(4000, 40, 5)
    cells, met = balls.Cells(frame(spark, x), "sample_id", "v", 3, balls.Scratch(spark)), 0
    (pids, lo, hi), at = cells.chunks[0], cells.centres
    for r in cells.table.collect():
        m, bound = np.frombuffer(r["raw"]).reshape(r["n"], -1), np.frombuffer(r["bound"])
        to = np.arccos(np.clip(m @ at.T, -1, 1))
        met += (to <= bound[:, None]).sum()
    assert met < 0.3 * len(x) * len(at)


def test_pairs_of_no_rows(spark):
    assert tuple(clusters.pairwise_stats(frame(spark, []), "sample_id").first()) == (0, None, None, None)
    assert clusters.core_distances(frame(spark, []), "sample_id", 3).count() == 0
    assert clusters.core_distances(frame(spark, unit_rows(1, 1, 0)), "sample_id", 3).count() == 0
