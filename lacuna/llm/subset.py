"""Choosing a varied subset: cluster-feature tree, Ward linkage, cut at k groups, the record nearest each centre.

A leaf entry weighs by its variety, not by its rows: entries that are alike share a weight of 1, so Ward's
linkage does not spend groups on the inside of a large group of like rows. A row belongs to the Ward
group of its nearest leaf entry, and each group gives the member nearest its centre.

One tree of ``LEAVES`` entries serves up to ``CENTRES`` groups. For larger subsets Ward's cut of that
tree gives cells, each cell gets a tree of its own and as many groups as its share of the weight;
trees and linkage of cells run in tasks. The driver sends the leaf entries to the tasks and holds nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import cftree
from lacuna.runtime import Scratch

#: Leaf entries of one tree, and the most groups that it is cut into.
LEAVES, CENTRES = 4096, 1024
#: Most cells, so that all leaf entries can be broadcast (64 values: 134 MB); larger subsets are refused.
MAX_CELLS = 128
#: Rows of a cell in one tree before merging.
BLOCK_ROWS = 32_768


def variety_mass(cents: np.ndarray, n: np.ndarray, min_similarity: float, block: int = 1024) -> np.ndarray:
    """Mass of each leaf entry: its share of the rows that are alike, so a group of like rows weighs 1 in all."""
    unit = _unit(cents).astype(np.float32)
    around = np.empty(len(n))
    for i in range(0, len(n), block):
        around[i : i + block] = (unit[i : i + block] @ unit.T >= min_similarity) @ n
    return n / np.maximum(around, n)


def ward_groups(n: np.ndarray, ls: np.ndarray, sizes: list[int], min_similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size the group of every leaf entry and the unit centres of the groups: one Ward tree, cut once per size."""
    cents = ls / n[:, None]
    mass = variety_mass(cents, n, min_similarity)
    merges = cftree.ward(cents, mass)
    out = []
    for k in sizes:
        group = cftree.cut(len(cents), merges, k)
        sums = np.zeros((group.max() + 1, cents.shape[1]))
        np.add.at(sums, group, cents * mass[:, None])
        out.append((group, _unit(sums)))
    return out


def shares(weights: dict[int, tuple[float, int]], k: int) -> dict[int, int]:
    """``k`` places dealt in proportion to the weights, never more than the second number of each; the largest remainders get the rest."""
    out = dict.fromkeys(weights, 0)
    while (left := min(k, sum(most for _, most in weights.values())) - sum(out.values())) > 0:
        free = {c: w for c, (w, most) in weights.items() if out[c] < most}
        exact = {c: left * w / sum(free.values()) for c, w in free.items()}
        dealt = {c: min(int(x), weights[c][1] - out[c]) for c, x in exact.items()}
        if not any(dealt.values()):
            dealt = dict.fromkeys(sorted(free, key=lambda c: (-exact[c], c))[:left], 1)
        for c, x in dealt.items():
            out[c] += x
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def varied_subset(vectors: DataFrame, key: str, sizes: list[int], min_similarity: float = 0.8) -> DataFrame:
    """``(size, key, similarity)``: for each size so many different rows of ``vectors`` (key, v), or all if there are fewer.

    ``vectors`` must hold unit vectors, one row per key, and be cheap to read again (a written table).
    Rows with a similarity of ``min_similarity`` or more count as alike: a group of like rows has mass 1
    whatever its size, so it takes more than one place only where the cut is finer than the groups. Each
    Ward group gives the row nearest its centre (ties: the smaller key), with that similarity. Where the rows
    have fewer different leaf entries than places, the rows farthest from the centres of the heaviest groups
    follow, then rows by their key, with similarity null. An empty table gives an empty result; a size of 0 or
    less gives no rows; a size over ``MAX_CELLS * CENTRES`` (131,072) that is less than all rows is refused.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    total = vectors.count()
    out = spark.createDataFrame([], f"size long, `{key}` {kind}, similarity double")
    for k in sorted({k for k in sizes if k >= total}):
        out = out.unionByName(vectors.select(F.lit(k).cast("long").alias("size"), key, F.lit(1.0).alias("similarity")))
    asked = sorted({k for k in sizes if 0 < k < total})
    if not asked:
        return out
    if asked[-1] > MAX_CELLS * CENTRES:
        raise ValueError(f"a subset of {asked[-1]} rows is more than {MAX_CELLS * CENTRES}")
    dim = len(vectors.select("v").first()[0])
    scratch = Scratch(spark)
    top = scratch.write(cftree.summary(vectors, dim, LEAVES), "top")
    for cells in sorted({-(-k // CENTRES) for k in asked}):
        mine = [k for k in asked if -(-k // CENTRES) == cells]
        out = out.unionByName(_chosen(vectors, key, dim, top, cells, mine, min_similarity, scratch))
    return out


def _chosen(vectors: DataFrame, key: str, dim: int, top: DataFrame, cells: int, sizes: list[int], min_similarity: float, scratch: Scratch) -> DataFrame:
    """The rows of the sizes that are cut from so many cells."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    n, ls, _ = cftree.ordered(top.toPandas(), dim)
    cell_of = ward_groups(n, ls, [cells], min_similarity)[0][0]
    route = spark.sparkContext.broadcast((_unit(ls).astype(np.float32), cell_of.astype(np.int32)))
    trees = top if cells == 1 else scratch.write(_cell_trees(vectors, key, dim, route), f"trees{cells}")

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ls, _ = cftree.ordered(pdf, dim)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "mass": [variety_mass(ls / n[:, None], n, min_similarity).sum()], "most": [len(n)]})

    weighed = trees.groupBy("cell").applyInPandas(weigh, "cell int, mass double, most int")
    weights = {r["cell"]: (r["mass"], r["most"]) for r in weighed.collect()}
    places = [shares(weights, k) for k in sizes]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Ward's groups of one cell for each size: the leaf entries, the group of each, and the centres."""
        cell = int(pdf["cell"].iloc[0])
        n, ls, _ = cftree.ordered(pdf, dim)
        at = [i for i, p in enumerate(places) if p[cell]]
        found = ward_groups(n, ls, [places[i][cell] for i in at], min_similarity)
        packed = [x.astype(np.int32).tobytes() for x, _ in found], [x.astype(np.float32).tobytes() for _, x in found]
        return pd.DataFrame([(cell, _unit(ls).astype(np.float32).tobytes(), at, *packed)], columns=["cell", "units", "at", "groups", "centres"])

    linked = trees.groupBy("cell").applyInPandas(link, "cell int, units binary, at array<int>, groups array<binary>, centres array<binary>").collect()
    floats = lambda x: np.frombuffer(x, np.float32).reshape(-1, dim)
    plan = {r["cell"]: (floats(r["units"]), [(at, np.frombuffer(g, np.int32), floats(c)) for at, g, c in zip(r["at"], r["groups"], r["centres"])]) for r in linked}
    sent = spark.sparkContext.broadcast(plan)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each group the member nearest its centre and the one farthest from it, in this partition."""
        top_units, top_cells = route.value
        near: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            v = np.array(b["v"].tolist(), dtype=np.float32)
            home = top_cells[(v @ top_units.T).argmax(axis=1)] if len(sent.value) > 1 else np.zeros(len(v), np.int32)
            for c in np.unique(home):
                own = np.flatnonzero(home == c)
                units, cuts = sent.value[c]
                entry = (v[own] @ units.T).argmax(axis=1)
                for at, groups, centres in cuts:
                    g = groups[entry]
                    sims = np.einsum("ij,ij->i", v[own], centres[g]).astype(float)
                    near.append(pd.DataFrame({"at": at, "cell": c, "g": g, key: b[key].to_numpy()[own], "near": sims, "rows": 1}))
            near = [_ends(pd.concat(near), key)]
        if near:
            yield near[0]

    schema = f"at int, cell int, g int, `{key}` {kind}, near double, rows long"
    found = vectors.select(key, "v").mapInPandas(best, schema)
    nearest, farthest = F.struct(-F.col("near"), F.col(key)), F.struct(F.col("near"), F.col(key))
    groups = found.groupBy("at", "cell", "g").agg(F.min_by(F.struct(key, "near"), nearest).alias("a"), F.min_by(F.struct(key, "near"), farthest).alias("z"), F.sum("rows").alias("rows"))
    groups = scratch.write(groups, f"groups{cells}")
    out = None
    for i, k in enumerate(sizes):
        own = groups.where(F.col("at") == i)
        picks = own.select("a.*")
        missing = k - picks.count()
        chosen = picks.select(F.lit(k).cast("long").alias("size"), key, F.col("near").alias("similarity"))
        if missing:  # fewer groups than places: at most k rows of the farthest, then by key
            far = own.where(F.col(f"a.{key}") != F.col(f"z.{key}")).orderBy(F.desc("rows"), "cell", "g").select(f"z.{key}").limit(missing)
            taken = picks.select(key).unionByName(far)
            rest = vectors.select(key).join(taken, key, "left_anti").orderBy(key).limit(missing)
            more = far.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1))).orderBy("_o", key).limit(missing)
            chosen = chosen.unionByName(more.select(F.lit(k).cast("long").alias("size"), key, F.lit(None).cast("double").alias("similarity")))
        out = chosen if out is None else out.unionByName(chosen)
    return out


def _ends(f: pd.DataFrame, key: str) -> pd.DataFrame:
    """The nearest member of each group, with the count of all, and the farthest one."""
    group = ["at", "cell", "g"]
    near = f.sort_values(["near", key], ascending=[False, True], kind="stable")
    far = near.sort_values(["near", key], kind="stable")
    near = near.assign(rows=near.groupby(group, sort=False)["rows"].transform("sum"))
    return pd.concat([x[~x.duplicated(group)] for x in (near, far.assign(rows=0))], ignore_index=True)


def _cell_trees(vectors: DataFrame, key: str, dim: int, route) -> DataFrame:
    """Leaf entries of one tree for each cell: rows go to blocks of their cell, a tree for each block, then merges."""
    kind = vectors.schema[key].dataType.simpleString()

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, cell_of = route.value
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), dtype=np.float32)
                yield pd.DataFrame({key: b[key], "cell": cell_of[(v @ units.T).argmax(axis=1)], "v": [x.tobytes() for x in v]})

    placed = vectors.select(key, "v").mapInPandas(to_cell, f"`{key}` {kind}, cell int, v binary")
    blocks = -(-max(r["count"] for r in placed.groupBy("cell").count().collect()) // BLOCK_ROWS)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        tree = cftree.CFTree(dim, 0.0, LEAVES)
        tree.insert_rows(np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1).astype(float))
        return cftree.rows_of(tree, int(pdf["cell"].iloc[0]), int(pdf["_part"].iloc[0]))

    salted = placed.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return cftree.reduced(salted.groupBy("cell", "_part").applyInPandas(build, cftree.SUMMARY), blocks, dim, LEAVES)
