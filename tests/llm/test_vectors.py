"""Operators on vectors: trees, subset, groups, neighbours, batches, top N."""

import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.llm import cftree, dedup, grouping, ivfpq, subset, topn
from lacuna.runtime import Scratch
from lacuna.sources import tables
from tests.llm.fixtures import groups, table, unit


def test_features_add_up_and_merge():
    m, _ = groups([40, 30, 20, 1])
    a, b = cftree.CFTree(64, 0.6), cftree.CFTree(64, 0.6)
    a.insert_rows(m[:50])
    b.insert_rows(m[50:])
    both = cftree.CFTree(64, 0.6)
    for tree in (a, b):
        n, ls, ss = tree.entries()
        both.insert_rows(ls, n, ss)
    n, ls, ss = both.entries()
    assert n.sum() == 91 and np.allclose(ls.sum(axis=0), m.sum(axis=0)) and np.isclose(ss.sum(), 91.0)
    assert len(n) == 4


def test_tree_is_bounded():
    m, _ = groups([1] * 500)
    tree = cftree.CFTree(64, 0.0, max_leaves=64)
    tree.insert_rows(m)
    n, ls, _ = tree.entries()
    assert len(n) <= 64 and n.sum() == 500 and np.allclose(ls.sum(axis=0), m.sum(axis=0))


def test_ward_matches_brute_force():
    rng = np.random.default_rng(3)
    c, w = rng.standard_normal((30, 5)), rng.integers(1, 9, 30).astype(float)
    live = {i: (c[i], w[i]) for i in range(30)}
    costs = []
    while len(live) > 1:
        pairs = [(live[i][1] * live[j][1] / (live[i][1] + live[j][1]) * ((live[i][0] - live[j][0]) ** 2).sum(), i, j) for i in live for j in live if i < j]
        cost, i, j = min(pairs)
        (a, n), (b, m) = live[i], live.pop(j)
        live[i] = ((n * a + m * b) / (n + m), n + m)
        costs.append(cost)
    assert np.allclose(sorted(costs), [x[2] for x in cftree.ward(c, w)])


def test_whole_components_need_no_agglomeration(monkeypatch):
    m, label = groups([1] * 50 + [2] * 60 + [30], noise=0.03)
    order = np.random.default_rng(1).permutation(len(m))
    m, label = m[order], label[order]
    want = [int(np.flatnonzero(label == x)[0]) for x in label]
    chain = unit(np.array([[1, 0, 0], [0.9, 0.45, 0], [0.62, 0.8, 0], [0, 0, 1.0]]))  # neighbours are alike, the ends are not
    assert [x.tolist() for x in cftree.components(chain, 0.8)] == [[0, 0, 0, 3], [False, False, False, True]]
    assert len(set(cftree.alike_groups(chain, np.ones(4), 0.8))) == 3
    n, ls, ss = cftree.like_rows(np.concatenate([chain, chain]), 0.6, 0.8)
    assert n.sum() == 8 and np.allclose(ls.sum(axis=0), 2 * chain.sum(axis=0)) and np.isclose(ss.sum(), 8)

    def refused(*_):
        raise AssertionError("row by row")

    monkeypatch.setattr(cftree, "ward", refused)
    monkeypatch.setattr(cftree.CFTree, "insert", refused)
    assert cftree.alike_groups(m, np.ones(len(m)), 0.8, block=16).tolist() == want
    n, ls, _ = cftree.like_rows(m, 0.6, 0.8)
    assert sorted(n) == [1] * 50 + [2] * 60 + [30] and np.allclose(ls.sum(axis=0), m.sum(axis=0))


def test_trees_in_bulk_hold_all_rows_and_keep_a_hot_group_whole(spark, tmp_path, monkeypatch):
    m, label = groups([1] * 300 + [2000], noise=0.03)
    rows = m[np.random.default_rng(1).permutation(len(m))]
    one = np.ones(len(rows))
    ls, n, ss = cftree.bulk(rows, one, one, 100)
    assert len(n) <= 100 and n.sum() == len(rows) and np.allclose(ls.sum(axis=0), rows.sum(axis=0)) and np.isclose(ss.sum(), len(rows))
    hot = unit(m[label == 300].mean(axis=0, keepdims=True))[0]
    ls, n, ss = cftree.like_joined(*cftree.bulk(rows, one, one, 400))
    assert n.sum() == len(rows) and ((ls @ hot) / np.linalg.norm(ls, axis=1) > 0.9).sum() == 1
    monkeypatch.setattr(cftree.CFTree, "_condense", lambda self: 1 / 0)
    df = table(spark, rows[:600], tmp_path / "v")
    n, ls, _ = cftree.bulk_summary(df, 64, 50, chunk=70, fan_in=2)
    assert len(n) <= 50 and n.sum() == 600 and np.allclose(ls.sum(axis=0), rows[:600].sum(axis=0), atol=1e-3)


def test_nearest_cells_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    cells, v = (unit(rng.standard_normal((n, 64))).astype(np.float32) for n in (1000, 10_000))
    tracemalloc.start()
    got = grouping.nearest_cells(cells, v, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.argsort(-(v[::500] @ cells.T), axis=1)[:, :12]
    assert (np.sort(got[::500]) == np.sort(want)).all() and got.shape == (10_000, 12) and peak < 40e6


def test_groups_equal_brute_force(spark, tmp_path):
    m, label = groups([300, 40, 7, 3, 2, 1, 1, 1])
    df = table(spark, np.concatenate([m, m[:5]]), tmp_path / "v")
    label = np.concatenate([label, label[:5]])
    got = {r["id"]: (r["first"], r["size"]) for r in grouping.similarity_groups(df, "id", Scratch(spark)).collect()}
    first = {g: f"s{np.flatnonzero(label == g)[0]:05d}" for g in set(label)}
    assert got == {f"s{i:05d}": (first[g], int((label == g).sum())) for i, g in enumerate(label)}


def test_hot_group_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grouping, "BLOCK_ROWS", 50)
    m, _ = groups([400] + [1] * 100)
    out = grouping.similarity_groups(table(spark, m, tmp_path / "v"), "id", Scratch(spark))
    assert {r[0]: r[1] for r in out.groupBy("size").count().collect()} == {400: 400, 1: 100}


def test_typical_members(spark, tmp_path):
    m, label = groups([20, 4, 1])
    out = grouping.typical_members(grouping.similarity_groups(table(spark, m, tmp_path / "v"), "id", Scratch(spark)), "id", 3).collect()
    assert len(out) == 3 + 3 + 1
    centre = unit(m[label == 0].mean(axis=0, keepdims=True))[0]
    best = np.argsort(-(m[label == 0] @ centre))[:3]
    assert {r["id"] for r in out if r["size"] == 20} == {f"s{i:05d}" for i in best}


@pytest.mark.parametrize("op", ["groups", "subset", "similar"])
def test_empty_vectors(spark, tmp_path, op):
    df = table(spark, np.zeros((0, 64)), tmp_path / "v")
    out = {"groups": lambda: grouping.similarity_groups(df, "id", Scratch(spark)), "subset": lambda: subset.varied_subset(df, "id", [3]), "similar": lambda: ivfpq.most_similar(df, "id", 3, Scratch(spark))}
    assert out[op]().count() == 0


def test_subset_takes_each_group_once(spark, tmp_path):
    m, label = groups([500, 60, 20, 5, 5, 5, 1, 1, 1, 1])
    df = table(spark, m, tmp_path / "v")
    out = subset.varied_subset(df, "id", [10, 4, 10_000, 0]).collect()
    by = {k: [r["id"] for r in out if r["size"] == k] for k in (10, 4, 10_000, 0)}
    assert [len(by[k]) for k in (10, 4, 10_000, 0)] == [10, 4, len(m), 0]
    assert {label[int(i[1:])] for i in by[10]} == set(range(10))
    assert len({label[int(i[1:])] for i in by[4]}) == 4
    again = subset.varied_subset(df, "id", [10]).collect()
    assert {r["id"] for r in again} == set(by[10])


def test_large_subset_is_cut_from_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(subset, "CENTRES", 8)
    monkeypatch.setattr(subset, "BLOCK_ROWS", 40)
    m, label = groups([300, 60, 20] + [2] * 40)
    df = table(spark, m, tmp_path / "v")
    out = [r["id"] for r in subset.varied_subset(df, "id", [30]).collect()]
    assert len(out) == len(set(out)) == 30
    assert len({label[int(i[1:])] for i in out}) >= 26
    monkeypatch.setattr(subset, "MAX_CELLS", 2)
    with pytest.raises(ValueError):
        subset.varied_subset(df, "id", [30])


def test_record_is_nearest_the_centre_of_its_group(spark, tmp_path):
    m, label = groups([40, 30, 20])
    out = {r["id"]: r["similarity"] for r in subset.varied_subset(table(spark, m, tmp_path / "v"), "id", [3]).collect()}
    for g in range(3):
        own = np.flatnonzero(label == g)
        centre = unit(m[own].mean(axis=0, keepdims=True))[0]
        best = own[np.argmax(m[own] @ centre)]
        assert f"s{best:05d}" in out


def test_places_are_dealt_by_weight():
    assert subset.shares({0: (50.0, 90), 1: (30.0, 90), 2: (20.0, 90)}, 10) == {0: 5, 1: 3, 2: 2}
    assert subset.shares({0: (8.0, 2), 1: (1.0, 9), 2: (1.0, 9)}, 7) == {0: 2, 1: 3, 2: 2}
    assert subset.shares({0: (2.0, 2), 1: (1.0, 1)}, 9) == {0: 2, 1: 1}


def test_subset_of_copies_is_whole(spark, tmp_path):
    m, _ = groups([1, 1])
    df = table(spark, np.repeat(m, 20, axis=0), tmp_path / "v")
    out = [r["id"] for r in subset.varied_subset(df, "id", [7]).collect()]
    assert len(out) == len(set(out)) == 7


def exact_neighbours(m, ids, k):
    s = np.round(m.astype(np.float32).astype(float) @ m.astype(np.float32).astype(float).T, 6)
    out = set()
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(ids[i], ids[j], r + 1) for r, j in enumerate(order)}
    return out


def test_neighbours_recall(spark, tmp_path):
    m, _ = groups([200, 100, 50] + [6] * 60 + [1] * 90)
    df = table(spark, m, tmp_path / "v")
    got = {(r["id"], r["other"], r["rank"]) for r in ivfpq.most_similar(df, "id", 3, Scratch(spark)).collect()}
    want = exact_neighbours(m, [f"s{i:05d}" for i in range(len(m))], 3)
    assert len(got) == len(want) and len(got & want) >= 0.97 * len(want)


def test_neighbours_of_copies_and_few_rows(spark, tmp_path):
    m, _ = groups([1, 1, 1])
    rows = np.concatenate([np.repeat(m[:1], 30, axis=0), m[1:]])
    ids = [f"s{i:05d}" for i in range(len(rows))]
    got = {(r["id"], r["other"], r["rank"]) for r in ivfpq.most_similar(table(spark, rows, tmp_path / "v"), "id", 3, Scratch(spark)).collect()}
    assert {x for x in exact_neighbours(rows, ids, 3) if x[0] < "s00030"} == {x for x in got if x[0] < "s00030"}
    two = ivfpq.most_similar(table(spark, m[:2], tmp_path / "w"), "id", 3, Scratch(spark)).collect()
    assert sorted((r["id"], r["other"]) for r in two) == [("s00000", "s00001"), ("s00001", "s00000")]


def test_neighbours_in_slices_leave_no_vectors_behind(spark, tmp_path, monkeypatch):
    m, _ = groups([200, 100, 50] + [6] * 60 + [1] * 90)
    m = np.concatenate([m, np.repeat(m[:1], 7, axis=0)])  # copies too
    ids = [f"s{i:05d}" for i in range(len(m))]
    scratch = Scratch(spark)
    once = lambda name: scratch.write(table(spark, m, tmp_path / name), name)
    whole = {tuple(r) for r in ivfpq.most_similar(once("v"), "id", 3, scratch).collect()}
    for name, n in (("SLICE_ROWS", 100), ("BLOCK_ROWS", 40), ("SHORT_ROWS", 10), ("SHARD_ROWS", 60)):
        monkeypatch.setattr(ivfpq, name, n)
    cut = {tuple(r) for r in ivfpq.most_similar(once("w"), "id", 3, scratch, spent="w").collect()}
    want = exact_neighbours(m, ids, 3)
    for got in (whole, cut):
        assert len(got) == len(want) and len({(a, b, r) for a, b, _, r in got} & want) >= 0.97 * len(want)
    assert len(whole & cut) >= 0.97 * len(whole)
    left = {p.name for p in (Path(scratch.base.removeprefix("file:"))).iterdir()}
    assert "similar5" in left and not left & {"w", "first", "routed", "lists"}


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    got = Scratch(spark).write(spark.range(20_000).groupBy((F.col("id") * 7).alias("k")).count(), "counted")
    end = time.time() + 10  # they go in the background
    while (left := files() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and got.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_come_once(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 1), ("b", "a", 0.9, 1), ("c", "a", 0.7, 1)], "id string, other string, similarity double, rank int")
    assert [tuple(r) for r in ivfpq.similar_pairs(df, "id", 0.8).collect()] == [("a", "b")]


HISTORY = "file_hash string, embedding array<float>, dim int, seq int"
BATCH = "entry_id long, batch_no int, file_hash string, embedding array<float>, ref long"


def entries(m, labels=None):
    return [[float(x) for x in v] for v in m]


def brute(history, batch):
    """Entry ids that repeat, by definition."""
    tidy = lambda h: (h or "").strip().lower() or None
    ok = lambda v: v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    seen = [(tidy(h), np.array(v, float) if ok(v) else None) for h, v, *_ in history]
    out, done = set(), set()
    for e, _, h, v, _ in sorted((b for b in batch if b[0] is not None), key=lambda b: b[0]):
        if e in done:
            continue
        done.add(e)
        v = np.array(v, float) if ok(v) else None
        for h2, v2 in seen:
            if (tidy(h) and tidy(h) == h2) or (v is not None and v2 is not None and v @ v2 / np.linalg.norm(v) / np.linalg.norm(v2) >= 0.95):
                out.add(e)
        seen.append((tidy(h), v))
    return out


def batches():
    m, _ = groups([30, 8, 3] + [1] * 60, noise=0.02, seed=5)
    history = [(f"h{i}", v, 64, 0) for i, v in enumerate(entries(m[:60]))] + [("hx", None, 64, 0), (None, [], 0, 0), ("hy", [float("nan")] * 64, 64, 0), ("hz", [0.0] * 64, 64, 0)]
    rng = np.random.default_rng(1)
    new = [(i + 1, i // 20, f"n{i}", v, 0) for i, v in enumerate(entries(unit(m[rng.integers(0, len(m), 60)] + 0.02 * rng.standard_normal((60, 64)))))]
    new += [(100, 9, " H3\t", None, 0), (101, 9, "n1", [1.0] * 3, 0), (102, 9, None, None, 0), (103, 9, "  ", None, 0), (104, 9, "  ", None, 0), (105, 9, "q", entries(m[:1])[0], 0), (105, 9, "q", entries(m[:1])[0], 0), (None, 9, "h1", None, 0)]
    new += [(106, 9, "r", [0.0] * 63 + [1e30], 0), (107, 9, "s", [0.0] * 63 + [2e30], 0), (108, 9, "t", [None] + [1.0] * 63, 0), (109, 9, "u", [0.0] * 64, 0)]
    return history, new


def found(spark, history, *deliveries, folder=None):
    folder = folder or Scratch(spark).path("store")
    dedup.FingerprintStore.create(spark.createDataFrame(history, HISTORY), folder).close()
    out = []
    for d in deliveries:
        store = dedup.FingerprintStore.open(spark, folder)
        out.append({r[0] for r in dedup.accept(store, spark.createDataFrame(d, BATCH)).collect()})
        store.close()
    return set().union(*out)


def test_batches_equal_brute_force(spark):
    history, new = batches()
    assert found(spark, history, new) == brute(history, new)


def test_batches_one_by_one_equal_all_at_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_PARTS", 2)  # so the store is compacted in between
    history, new = batches()
    cut = [[b for b in new if b[0] and a < b[0] <= z] for a, z in ((0, 20), (20, 30), (30, 99), (99, 200))]
    assert found(spark, history, *cut) == brute(history, new)


def test_outgrown_store_gets_a_new_layout(spark, monkeypatch):
    monkeypatch.setattr(dedup, "layout_for", lambda n, of=dedup.layout_for: dedup.Layout(18 if n < 70 else 20, 384 if n < 70 else 512, 4, max(62, n)))
    history, new = batches()
    folder = Scratch(spark).path("store")
    cut = [[b for b in new if b[0] and a < b[0] <= z] for a, z in ((0, 40), (40, 200))]
    assert found(spark, history, *cut, folder=folder) == brute(history, new)
    assert dedup.FingerprintStore.open(spark, folder).manifest.layout.gram == 20


def test_dense_group_is_looked_up_in_rounds(spark, monkeypatch):
    for name, n in (("SLICE", 1), ("MANY", 1), ("FEW", 1), ("BLOCK_KEYS", 500), ("HITS", 7)):
        monkeypatch.setattr(dedup, name, n)
    history, new = batches()
    assert found(spark, history, new) == brute(history, new)


def test_empty_history_and_empty_batch(spark):
    history, new = batches()
    assert found(spark, [], new) == brute([], new)
    assert found(spark, history, []) == set()


def test_deliveries_queue_and_overlaps_go_together(spark):
    rows = [(1, 1), (2, 1), (3, 2), (4, 3), (9, 3), (7, 4), (20, 5), (None, 5)]
    df = spark.createDataFrame([(e, b) for e, b in rows], "entry_id long, batch_no int")
    assert dedup.deliveries(df, 0.0, 100) == [(1, 2), (3, 3), (4, 9), (20, 20)]
    assert dedup.deliveries(df, 0.2, 10) == [(1, 2), (3, 9), (20, 20)]


def test_store_outlives_the_process(spark, tmp_path):
    """Another process opens the store and finds the repeats; it fingerprints its own batch only."""
    import json
    import subprocess
    import sys

    history, new = batches()
    folder = f"file://{tmp_path}/store"
    dedup.FingerprintStore.create(spark.createDataFrame(history, HISTORY), folder).close()
    spark.createDataFrame(new, BATCH).write.parquet(f"{tmp_path}/batch")
    code = f"""
import json
import numpy as np
from pyspark.sql import SparkSession
from lacuna.llm import dedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows, of = spark.sparkContext.accumulator(0), dedup.fingerprints
def counted(v, layout):
    rows.add(len(v))
    return of(v, layout)
dedup.fingerprints = counted
store = dedup.FingerprintStore.open(spark, {folder!r})
out = sorted(r[0] for r in dedup.accept(store, spark.read.parquet("{tmp_path}/batch")).collect())
print("RESULT", json.dumps([out, rows.value, store.manifest.parts]))
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    got = json.loads(run.stdout.split("RESULT", 1)[1])
    assert set(got[0]) == brute(history, new)
    assert 0 < got[1] <= len(new) and len(got[2]) == 2


def test_runs_take_less_than_they_are_long(spark, tmp_path):
    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 1 << 32, 30_000, dtype=np.uint32))
    run = dedup.Run(keys, rng.integers(0, 3000, len(keys)).astype(np.int32), np.arange(3000) + dedup.BEFORE_ALL, rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64))
    row = run.row()
    back = dedup.Run.read(pd.DataFrame([row]))
    assert all((getattr(back, c) == getattr(run, c)).all() for c in ("keys", "at", "refs", "covers"))
    Scratch(spark)  # the folder is set
    path = tmp_path / "run"
    spark.createDataFrame([tuple(bytearray(row[c]) for c in ("keys", "at", "refs", "covers"))], dedup.RUN).coalesce(1).write.options(**dedup.CODEC).parquet(str(path))
    size = sum(p.stat().st_size for p in path.glob("*.parquet"))
    assert size - run.covers.nbytes < 0.65 * (run.keys.nbytes + run.at.nbytes + run.refs.nbytes)


def test_part_that_was_never_committed_is_not_read(spark):
    history, new = batches()
    folder = Scratch(spark).path("store")
    store = dedup.FingerprintStore.create(spark.createDataFrame(history, HISTORY), folder)
    store._commit = lambda *_: None  # the process dies before the manifest is written
    dedup.accept(store, spark.createDataFrame(new, BATCH))
    store.close()
    again = dedup.FingerprintStore.open(spark, folder)
    assert {r[0] for r in dedup.accept(again, spark.createDataFrame(new, BATCH)).collect()} == brute(history, new)
    again.close()


def test_like_vectors_share_a_fingerprint():
    """At a similarity of 0.95 nearly all pairs meet, whatever the layout."""
    rng = np.random.default_rng(3)
    a, b = unit(rng.standard_normal((1500, 64))), rng.standard_normal((1500, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    for n in (1000, 1_000_000):
        layout = dedup.layout_for(n)
        runs = []
        for v, first in ((a, 0), (0.95 * a + np.sqrt(1 - 0.95**2) * b, 10_000)):
            keys, at, covers = dedup.fingerprints(v.astype(np.float32), layout)
            runs.append(dedup.Run(keys, at, np.arange(len(v)) + first, covers).by_key())
        hits = dedup.matches(runs[1], runs[0], 0, 64, True)
        hits = hits[~hits["more"]]
        assert (hits["ref"] - 10_000 == hits["t_ref"]).sum() >= 1490


def test_runs_of_a_shard_come_once_for_all_blocks_of_probes(monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_KEYS", 300)
    m, _ = groups([3] * 40, noise=0.02)
    layout = dedup.layout_for(len(m))
    keys, at, covers = dedup.fingerprints(m.astype(np.float32), layout)
    run = dedup.Run(keys, at, np.arange(len(m), dtype=np.int64), covers).by_key()
    columns = ["shard", "block", "keys", "at", "refs", "covers"]
    runs, asks = pd.DataFrame(run.blocks(0, 0, 1))[columns], pd.DataFrame(run.take(np.flatnonzero(run.at >= 60)).by_key().blocks(1, 0, 2))[columns]
    got = dedup._looker(0, 64, True)(asks, runs)
    want = dedup.matches(dedup.Run.read(asks), dedup.Run.read(runs).by_key(), 0, 64, True)
    assert len(runs) > 10 and len(asks) > 5 and len(want) > 30
    assert set(zip(got["ref"], got["t_ref"])) == set(zip(want["ref"], want["t_ref"]))
    again = dedup._looker(0, 64, True)(asks, runs.sample(frac=1, random_state=1))
    assert set(zip(again["ref"], again["t_ref"])) == set(zip(got["ref"], got["t_ref"]))
    assert not len(dedup._looker(0, 64, True)(asks, runs[:0])) and not len(dedup._looker(0, 64, True)(asks[:0], runs))


def test_packed_rows_lie_in_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    scratch = Scratch(spark)
    packed = scratch.write(spark.range(0, 60, 1, 1).mapInPandas(
        lambda batches: (pd.DataFrame({"id": b["id"], "keys": [np.random.default_rng(i).bytes(1 << 20) for i in b["id"]]}) for b in batches), "id long, keys binary"), "packed")
    assert packed.count() == 60
    files = [pq.ParquetFile(f) for f in (x.removeprefix("file://") for x in packed.inputFiles())]
    sizes = [f.metadata.row_group(i).total_byte_size for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(sizes) > 60 << 20 and max(sizes) < 24 << 20


def test_bloom_filter_never_loses_a_key():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 31, 5000).astype(np.uint32))
    bits = dedup.bloom_filter(keys)
    assert dedup.asked_before(bits, keys).all()
    assert dedup.asked_before(bits, np.arange(1 << 31, (1 << 31) + 5000).astype(np.uint32)).mean() < 0.05
    order = rng.permutation(5000)
    again = dedup.seen_earlier(np.concatenate([keys, keys[:100]]), np.concatenate([order, order[:100] + 5000]))
    assert again[5000:].all() and again[:5000].mean() < 0.05


def top(rows, n):
    out = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))[:n]
        out |= {(g, r[1], i + 1) for i, r in enumerate(own)}
    return out


@pytest.mark.parametrize("least", [10_000, 20])
def test_top_n_with_hot_groups(spark, least):
    rng = np.random.default_rng(0)
    rows = [(int(g), f"i{i:04d}", float(d)) for i, (g, d) in enumerate(zip(np.r_[np.zeros(400), rng.integers(1, 40, 200)], rng.integers(0, 9, 600)))] + [(None, "x", 1.0)]
    df = spark.createDataFrame(rows, "g int, id string, d double").withColumn("_slice", F.lit(1)).withColumn("_g", F.lit(2))
    out = topn.top_n(df, "g", [F.col("d").asc(), F.col("id").asc()], 3, heavy_share=0.0, heavy_least=least)
    assert {(r["g"], r["id"], r["rank"]) for r in out.collect()} == top(rows, 3)


def test_nearest_in_cluster_rules(spark):
    nan = float("nan")
    rows = [(1, "b", 0.0), (1, "a", -0.0), (1, "c", 2.0), (1, "d", 2.1), (1, "e", nan), (1, "f", None), (1, "g", -0.1), (-1, "h", 0.0), (None, "i", 0.0), (2, "j", 1.0)]
    df = spark.createDataFrame(rows, "cluster_id int, sample_id string, centroid_distance double")
    got = sorted((r["cluster_id"], r["sample_id"], r["rank"]) for r in topn.nearest_in_cluster(df, 3).collect())
    assert got == [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "j", 1)]
    assert topn.nearest_in_cluster(df.where("false"), 3).count() == 0


def test_current_and_usable(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    v = [1.0] * 64
    rows = [("a", t(1), v), ("a", t(2), [2.0] * 64), ("a", t(2), [2.0] * 64), ("b", None, v), (None, t(1), v), ("c", t(1), [1.0] * 63), ("d", t(1), [float("inf")] * 64), ("e", t(1), [0.0] * 64), ("f", t(1), None), ("g", t(1), [1e308] * 64)]
    df = spark.createDataFrame(rows, "sample_id string, updated_at timestamp_ntz, embedding array<double>")
    cur = tables.current_samples(df, ["sample_id", "embedding"])
    assert cur.count() == 7
    got = {r["sample_id"]: r["v"] for r in tables.usable_vectors(cur, "sample_id", "embedding").collect()}
    assert sorted(got) == ["a", "b", "g"] and np.allclose(got["g"], 0.125)


def test_rows_to_fit_come_packed_and_in_order(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, o = rng.standard_normal((700, 8)), rng.permutation(700)
    rows = spark.createDataFrame([(int(a), [float(c) for c in v]) for a, v in zip(o, x)], "o long, v array<double>").repartition(3)
    monkeypatch.setattr(type(rows), "toPandas", lambda *_: pytest.fail("all vectors as objects on the driver"))
    got = ivfpq.fitting_rows(rows, 500, 8, Scratch(spark))
    assert got.dtype == np.float32 and np.array_equal(got, x[np.argsort(o)][:500].astype(np.float32))
