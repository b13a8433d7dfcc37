"""Clustering on planted groups, whole runs, cache, projection and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import config
from lacuna.operators import clusters, density, embedding, kmeans, projection
from lacuna.plans import api, render
from lacuna.sources.cache import EmbeddingCache, compact, lookup
from lacuna.streaming import ingest


def planted(groups=4, per=12, lone=8, dim=512, noise=0.03, seed=42):
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((groups, dim)))
    rows = unit(np.repeat(centres, per, axis=0) + noise * rng.standard_normal((groups * per, dim)))
    return np.concatenate([rows, unit(rng.standard_normal((lone, dim)))]), np.r_[np.repeat(np.arange(groups), per), [-1] * lone]


def frame(spark, m):
    return spark.createDataFrame([(f"s{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)], "sample_id string, v array<double>")


def test_density_recovers_planted_groups(spark):
    m, truth = planted()
    got = density.hdbscan(frame(spark, m), "sample_id").orderBy("sample_id").collect()
    assert [r["cluster_id"] for r in got] == truth.tolist()
    assert all(r["cluster_confidence"] > 0.5 for r in got if r["cluster_id"] >= 0) and all(r["cluster_confidence"] == 0 for r in got if r["cluster_id"] < 0)


def test_density_of_few_rows_and_copies(spark):
    m, _ = planted(1, 2, 0, 8)
    assert [tuple(r)[1:] for r in density.hdbscan(frame(spark, m), "sample_id").collect()] == [(0, 1.0)] * 2
    assert density.hdbscan(frame(spark, np.repeat(m[:1], 6, axis=0)), "sample_id").count() == 6
    assert density.hdbscan(frame(spark, m).where("false"), "sample_id").count() == 0


def test_kmeans_recovers_planted_groups(spark):
    m, truth = planted(lone=0, dim=64)
    got = [r["cluster_id"] for r in kmeans.kmeans(frame(spark, m), "sample_id", 4, runs=5).orderBy("sample_id").collect()]
    assert len({(a, b) for a, b in zip(got, truth)}) == 4
    assert kmeans.clusters_for(9, 5) == 4 and kmeans.clusters_for(5, 5) == 5 and kmeans.clusters_for(1, 5) == 1


def test_isolated_without_pairs_equals_pairs(spark):
    m, _ = planted(6, 1, 0, 64, seed=1)
    m[5] = -m[:5].mean(axis=0) / np.linalg.norm(m[:5].mean(axis=0))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "cluster_id int, centroid array<double>")
    d = 1 - m @ m.T
    mean = (d.sum(axis=1) - d.diagonal()) / 5
    want = {i for i in range(6) if mean[i] > mean.mean() + 1.5 * mean.std()}
    got = {r["cluster_id"]: r["mean_distance"] for r in clusters.isolated(df).collect()}
    assert set(got) == want and all(np.isclose(got[i], mean[i]) for i in got)
    assert clusters.isolated(df.where("cluster_id < 2")).count() == 0
    near = {r["cluster_id"]: r["isolation"] for r in clusters.isolation(df).collect()}
    np.fill_diagonal(d, 9)
    assert all(np.isclose(near[i], d[i].min()) for i in range(6))


def test_cache_round_trip(spark, tmp_path):
    with EmbeddingCache(spark, str(tmp_path / "cache")) as c:
        v = [0.1, 0.2]
        new = spark.createDataFrame([("a", v, 2, "float32", 1.0), ("a", [9.0, 9.0], 2, "float32", 2.0), ("b", [1.0], 2, "float32", 1.0)], "file_hash string, embedding array<double>, dim int, dtype string, created_at double")
        c.put(new)
        c.put(new)
        assert c.stats()["entries"] == 2
        rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "file_hash string")
        got = {r["file_hash"]: r["cached"] for r in lookup(rows, c.read()).collect()}
        assert got == {"a": [9.0, 9.0], "b": None, "c": None, None: None}
        c.compact()
        assert c.read().count() == 2
        assert c.clear() == 2 and c.stats()["entries"] == 0
        assert compact(c.read()).count() == 0


def test_drift(spark):
    ids = lambda n: spark.createDataFrame([(str(i),) for i in range(n)], "id string")
    got = [projection.drift(ids(30), ids(n)).first()["retrain"] for n in (30, 35, 39, 40, 50)]
    assert got == [False, False, False, True, True]
    assert projection.drift(ids(0), ids(3)).first()["retrain"]


TEXTS = ["hard hat on site"] * 6 + ["fire drill in hall"] * 5 + ["forklift turns left"] * 4 + ["", None, "zebra quartz umbrella"]


def samples(spark, n=None):
    return spark.createDataFrame([(f"s{i:02d}", t, 1) for i, t in enumerate(TEXTS[:n])], "sample_id string, content string, distance int")


@pytest.mark.parametrize("n_clusters", [0, 3])
def test_two_runs_end_to_end(spark, tmp_path, n_clusters):
    cfg = config.AnalysisConfig(expected_categories="safety: hard hat, fire drill | other: submarine dive", n_clusters=n_clusters, gap_threshold=0.65)
    path = str(tmp_path / "history")
    for n in (12, None):
        run = api.analyze(samples(spark, n), cfg, "demo", embedding.HashingProvider(64))
        api.append_history(run, path)
    assert spark.read.parquet(path).count() == 2
    rows = run.samples.collect()
    assert len(rows) == len(TEXTS) and sum(r["embedding"] is not None for r in rows) == len(TEXTS) - 2
    assert all(r["cluster_id"] is not None and r["umap_x"] is not None and r["cluster_label"] for r in rows if r["embedding"] is not None)
    assert all(r["embedding_error"] for r in rows if r["embedding"] is None)
    assert 0 <= run.score.first()["coverage_score"] <= 1
    diff = api.last_diff(spark, path, "demo")
    assert diff["new_samples"] == len(TEXTS) - 12 and diff["trend"] in ("up", "down", "flat")
    report = api.draw(run, api.show_report(run, diff) | {"name": "demo"})
    assert any(g["name"] == "submarine dive" for g in report["priority_gaps"]) and "Since the last run" in report["markdown"]
    said = api.export_report(report, str(tmp_path / "out" / "page"))
    page = open(said["output_path"], encoding="utf-8").read()
    assert said["output_path"].endswith(".html") and page.startswith("<!doctype html") and said["size_bytes"] > 1000
    assert "<script" not in page and "<link" not in page and 'src="http' not in page
    payload = api.panel_payload(run)
    assert payload["traces"] and payload["score"] == report["summary"]["coverage_score"]


def test_run_guards(spark):
    with pytest.raises(api.EmptyDataset):
        api.analyze(samples(spark).where("false"), config.AnalysisConfig())
    with pytest.raises(api.NothingEmbedded):
        api.analyze(samples(spark), config.AnalysisConfig())


def test_category_vectors_must_be_of_the_samples_model(spark):
    with pytest.raises(ValueError, match="own model"):
        api.analyze(samples(spark), config.AnalysisConfig(expected_categories="a: b"))


def test_described_run(spark):
    """Labels and diversity come from the answers; where the first describer fails the next one is asked."""
    tried = spark.sparkContext.accumulator(0)

    def by_asset(sample_id):
        tried.add(1)
        raise RuntimeError("no asset")

    def by_index(sample_id):
        return "" if sample_id == "s14" else f"COMMON: people at work\nVARIATION: seen in {sample_id}"

    cfg = config.AnalysisConfig(n_clusters=3, describe=True)
    run = api.analyze(samples(spark), cfg, provider=embedding.HashingProvider(64), describers=[by_asset, by_index])
    rows = [r for r in run.samples.collect() if r["embedding"] is not None]
    assert tried.value > 0 and {r["cluster_label"] for r in rows} <= {"people at work", *(f"Cluster {i}" for i in range(3))}
    assert any(r["cluster_label"] == "people at work" and "seen in s" in r["cluster_diversity"] for r in rows)
    with pytest.raises(ValueError, match="describer"):
        api.analyze(samples(spark), cfg, provider=embedding.HashingProvider(64))


def test_cleared_run_and_model_used_again(spark):
    df = samples(spark).withColumn("embedding", F.array(*[F.lit(9.0)] + [F.lit(0.0)] * 63))
    kept = api.analyze(df, config.AnalysisConfig(n_clusters=2), provider=embedding.HashingProvider(64))
    wiped = api.analyze(df, config.AnalysisConfig(n_clusters=2, clear_cache=True), provider=embedding.HashingProvider(64), model=kept.extra["model"], known_ids=df.select("sample_id"))
    assert {r["embedding"][0] for r in kept.samples.collect() if r["embedding"]} == {9.0}
    assert all(r["embedding"][0] < 9.0 for r in wiped.samples.collect() if r["embedding"]) and wiped.extra["model"] is kept.extra["model"]


def test_kmeans_does_not_depend_on_how_rows_were_read(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "PARTITION_ROWS", 50)
    m, _ = planted(lone=12, dim=64)
    df = frame(spark, np.concatenate([m] * 3))
    got = [sorted(tuple(r) for r in kmeans.kmeans(df.repartition(n), "sample_id", 6, runs=2).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_chunks_are_sent_one_after_another(spark, monkeypatch):
    from lacuna.operators import blocks

    m, _ = planted(6, 5, 10, 64)
    df = frame(spark, m)
    whole = sorted(tuple(r) for r in blocks.nearest(df, "sample_id", "v", df.withColumnRenamed("sample_id", "ref"), "ref", "v").collect())
    monkeypatch.setattr(blocks, "CHUNK_ROWS", 9)
    cut = sorted(tuple(r) for r in blocks.nearest(df, "sample_id", "v", df.withColumnRenamed("sample_id", "ref"), "ref", "v").collect())
    assert [r[:2] for r in whole] == [r[:2] for r in cut]


def test_first_bytes_of_files(spark, tmp_path):
    import hashlib

    from lacuna.sources import files

    (tmp_path / "a b.bin").write_bytes(b"x" * 5000)
    got = {r["filepath"].rsplit("/", 1)[1]: r["file_hash"] for r in files.hash_files(spark, str(tmp_path), first_bytes=1000).collect()}
    assert list(got.values()) == [hashlib.sha256(b"x" * 1000).hexdigest()]


def test_lazy_description(spark):
    run = api.analyze(samples(spark), config.AnalysisConfig(n_clusters=3), provider=embedding.HashingProvider(64))
    session, calls = {}, []

    def service(sample_id):
        calls.append(sample_id)
        if len(calls) == 1:
            raise RuntimeError("busy")
        return "COMMON: x\nVARIATION: y"

    assert [api.describe_cluster(run, c, service, session)["source"] for c in (-1, 0, 0, 0)] == ["noise", "error", "lazy", "lazy"]
    assert len(calls) == 2


def test_csv_and_failing_provider(spark):
    assert render.cluster_csv([{"cluster_id": 1, "size": 2, "status": "thin", "cluster_label": 'a "b", c'}]) == (
        ",".join(render.CSV_COLUMNS) + '\r\n1,2,thin,,,"a ""b"", c",\r\n'
    )
    out = embedding.call_provider(spark.createDataFrame([("1", "fine"), ("2", "broken one")], "sample_id string, content string"), embedding.FailingProvider(embedding.HashingProvider(8)), first_wait=0.0)
    got = {r["sample_id"]: (r["embedding"] is not None, r["embedding_error"]) for r in out.collect()}
    assert got == {"1": (True, None), "2": (False, "RuntimeError: codec unsupported")}
    tally = embedding.failure_reasons(spark.createDataFrame([("x",)] * 3 + [("y",), ("",), (None,)], "embedding_error string"))
    assert [tuple(r) for r in tally.collect()] == [("x", 3), ("y", 1)]


def test_stream_is_embedded_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    schema = "sample_id string, content string"
    for part in range(2):
        spark.createDataFrame([(f"p{part}-{i}", f"word{i}") for i in range(5)] + [("none", None)], schema).write.mode("append").json(str(src))
        stream = spark.readStream.schema(schema).json(str(src))
        ingest.ingest(stream, cache, embedding.HashingProvider(8), out, str(tmp_path / "cp"), first_wait=0.0).awaitTermination()
    rows = spark.read.parquet(out)
    assert {r[0]: r[1] for r in rows.groupBy("status").count().collect()} == {"api": 5, "cache_hit": 5, "failed": 2}
    assert cache.stats()["entries"] == 5


def test_projection_is_kept_until_drift(spark, tmp_path):
    m, _ = planted(3, 10, 0, 16)
    df = frame(spark, m)
    base = str(tmp_path)
    assert ingest.projected(df, "d", base)[1] is True
    rows, again = ingest.projected(df.limit(20), "d", base)
    assert again is False and rows.where(F.col("umap_x").isNotNull()).count() == 20
    assert projection.clear(spark, "d", base) and projection.load(spark, "d", base) is None
