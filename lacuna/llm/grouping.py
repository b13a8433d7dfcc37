"""Grouping records into similarity clusters.

1. One cluster-feature tree of two levels per partition, built in bulk, merged to bounded leaf summaries; Ward
   agglomeration of the leaves gives coarse cells (broadcast: cells x dim floats, bounded by ``MAX_CELLS``).
2. Every row goes to its nearest cell; a cell is cut by salt into blocks of bounded size, whose
   rows become leaf entries that each hold like rows only (rows all alike are one, a finer tree takes the others), and the blocks of a cell
   are merged in rounds. So a group of any size leaves few entries in a cell.
3. Every leaf entry is compared in its few nearest cells, where Ward agglomeration merges like entries. The
   entry of most rows heads the merged ones; an entry follows its heads to the last one it is like.
4. One assignment pass over all rows: each goes to the nearest group centroid among those near its cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.functions import vectors as vec
from lacuna.llm import cftree
from lacuna.runtime import Scratch

MAX_CELLS = 4096
ROWS_PER_CELL = 512
BLOCK_ROWS = 4096
#: Cells in which a leaf entry is compared with others, and a centroid with rows.
PROBES = 12
#: Rows that meet all cells at once; with 4,096 cells these similarities and their order take 64 MB.
AT_ONCE = 1024
#: Leaf entries (about one a group) beyond which cells of one level would hold too many each to compare.
MAX_ENTRIES = 16_000_000


def coarse_cells(vectors: DataFrame, total: int, dim: int, rows_per_cell: int = ROWS_PER_CELL) -> np.ndarray:
    """Unit centres of at most ``MAX_CELLS`` cells."""
    wanted = int(min(MAX_CELLS, max(1, total // rows_per_cell)))
    n, ls, _ = cftree.bulk_summary(vectors, dim, min(2 * MAX_CELLS, max(1024, 4 * wanted)))
    cents = ls / n[:, None]
    group = cftree.cut(len(cents), cftree.ward(cents, n), wanted)
    sums = np.zeros((group.max() + 1, dim))
    np.add.at(sums, group, ls)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def nearest_cells(cells: np.ndarray, v: np.ndarray, probes: int) -> np.ndarray:
    m = min(probes, len(cells))
    return np.concatenate([np.argpartition(-(v[i : i + AT_ONCE] @ cells.T), m - 1, axis=1)[:, :m].astype(np.int32) for i in range(0, max(1, len(v)), AT_ONCE)])


def similarity_groups(vectors: DataFrame, key: str, scratch: Scratch, min_similarity: float = 0.8) -> DataFrame:
    """``(key, first, size, similarity)`` for every row of ``vectors`` (key, v): its group, named by its smallest key.

    ``vectors`` must hold unit vectors, one row per key, in a written table. A row alone is a group of
    size 1. ``similarity`` is that to the group's centroid. Equal vectors always share a group. An empty
    table gives an empty result. Where groups are not cleanly divided, every row is in the group of
    the nearest centroid found (ties: the older entry), and groups are those of centroids, not of chains.
    Lossy in one place: entries or centroids that share none of their ``PROBES`` nearest cells are not compared.
    More than ``MAX_ENTRIES`` leaf entries are refused.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], f"`{key}` {kind}, first {kind}, size long, similarity double")
    dim = len(vectors.select("v").first()[0])
    sent = spark.sparkContext.broadcast(coarse_cells(vectors, total, dim))

    def to_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist(), dtype=np.float32)
                cell = np.concatenate([(v[i : i + AT_ONCE] @ sent.value.T).argmax(axis=1) for i in range(0, len(v), AT_ONCE)])
                yield pd.DataFrame({key: b[key], "v": [x.tobytes() for x in v], "cell": cell.astype(np.int32)})

    placed = scratch.write(vectors.select(key, "v").mapInPandas(to_cell, f"`{key}` {kind}, v binary, cell int"), "placed")
    sizes = dict(placed.groupBy("cell").count().collect())
    salts = {c: -(-n // BLOCK_ROWS) for c, n in sizes.items()}
    many = [F.lit(x) for c, n in salts.items() if n > 1 for x in (c, n)]
    of = F.coalesce(F.create_map(*many)[F.col("cell")], F.lit(1)) if many else F.lit(1)
    rows = placed.withColumn("salt", F.pmod(F.xxhash64(key), of).cast("int"))
    radius = 0.95 * float(np.sqrt(2 - 2 * min_similarity))

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return cftree.summary_rows(*cftree.like_rows(_matrix(pdf["v"]).astype(float), radius, min_similarity), int(pdf["cell"].iloc[0]), int(pdf["salt"].iloc[0]))

    blocks = rows.groupBy("cell", "salt").applyInPandas(leaves, cftree.SUMMARY)
    merged = cftree.reduced(blocks, max(salts.values()), dim, 1 << 62, radius, fan_in=16)
    entries = scratch.write(merged.select(F.monotonically_increasing_id().alias("id"), "cell", F.col("n").cast("long").alias("n"), "ls"), "entries")
    if (count := entries.count()) > MAX_ENTRIES:
        raise ValueError(f"{count} leaf entries are more than cells of one level can compare ({MAX_ENTRIES})")

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = _unit(np.array(b["ls"].tolist(), dtype=float)).astype(np.float32)
                at = nearest_cells(sent.value, c, PROBES)
                take = np.repeat(np.arange(len(b)), at.shape[1])
                packed = [x.tobytes() for x in c]
                yield pd.DataFrame({"cell": at.ravel(), "id": b["id"].to_numpy()[take], "n": b["n"].to_numpy()[take], "c": [packed[i] for i in take]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        label = cftree.alike_groups(_matrix(pdf["c"]).astype(float), pdf["n"].to_numpy(), min_similarity)
        heads = pdf.assign(label=label).sort_values(["n", "id"], ascending=[False, True], kind="stable").drop_duplicates("label").set_index("label")
        return pd.DataFrame({"id": pdf["id"], "head": heads["id"].loc[label].to_numpy(), "n": heads["n"].loc[label].to_numpy()})

    visits = "cell int, id long, n long, c binary"
    tied = entries.select("id", "n", "ls").mapInPandas(to_cells, visits).groupBy("cell").applyInPandas(link, "id long, head long, n long")
    heads = scratch.write(tied.groupBy("id").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head")), "heads0")
    turn = 0
    while True:  # a head has more rows than those it heads, or an older number, so this ends
        turn += 1
        further = heads.select(F.col("id").alias("head"), F.col("head").alias("_next"))
        stepped = heads.join(further, "head").select("id", F.col("_next").alias("head"), (F.col("_next") != F.col("head")).alias("_moved"))
        stepped = scratch.write(stepped, f"heads{turn}")
        scratch.drop(f"heads{turn - 1}")
        heads = stepped.select("id", "head")
        if stepped.where("_moved").isEmpty():
            break
    ends = entries.select(F.col("id").alias("head"), F.col("ls").alias("_ls"))
    like = vec.cosine_similarity(F.col("ls"), F.col("_ls")) >= min_similarity
    moved = heads.where("id <> head").join(ends, "head").join(entries.select("id", "ls"), "id").where(like).select("id", "head")
    rooted = scratch.write(entries.join(moved, "id", "left").select(F.coalesce("head", "id").alias("root"), "cell", "n", "ls"), "rooted")

    sums = [F.sum(F.col("ls")[i]).alias(f"_{i}") for i in range(dim)]
    centroids = rooted.groupBy("root").agg(F.sum("n").alias("n"), *sums).select(F.col("root").alias("id"), "n", F.array(*[f"_{i}" for i in range(dim)]).alias("ls"))
    centroids = scratch.write(centroids, "centroids")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                c = _unit(np.array(b["ls"].tolist(), dtype=float)).astype(np.float32)
                yield pd.DataFrame({"cell": b["cell"], "id": b["id"], "c": [x.tobytes() for x in c]})

    # a centroid meets the rows of its nearest cells and of all cells that its entries come from
    homes = rooted.select("cell", F.col("root").alias("id")).distinct().join(centroids.select("id", "ls"), "id").select("cell", "id", "ls").mapInPandas(packed, "cell int, id long, c binary")
    near = centroids.mapInPandas(to_cells, visits).select("cell", "id", "c").unionByName(homes).dropDuplicates(["cell", "id"])

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({key: [], "cell": [], "salt": [], "root": [], "similarity": []})
        right = right.sort_values("id", kind="stable")
        ids, c, v = right["id"].to_numpy(), _matrix(right["c"]), _matrix(left["v"])
        best = (v @ c.T).argmax(axis=1)
        sims = np.einsum("ij,ij->i", v.astype(float), c[best].astype(float))
        return pd.DataFrame({key: left[key].to_numpy(), "cell": left["cell"].to_numpy(), "salt": left["salt"].to_numpy(), "root": ids[best], "similarity": sims})

    sent_to = near.withColumn("salt", F.explode(F.sequence(F.lit(0), of - 1)))
    assigned = rows.groupBy("cell", "salt").cogroup(sent_to.groupBy("cell", "salt")).applyInPandas(assign, f"`{key}` {kind}, cell int, salt int, root long, similarity double")
    assigned = scratch.write(assigned, "assigned")
    scratch.drop("placed")
    # names and sizes come back by block, so no join meets a whole group
    parts = assigned.groupBy("cell", "salt", "root").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
    names = parts.groupBy("root").agg(F.sum("_n").alias("size"), F.min("_first").alias("first"))
    return assigned.join(parts.select("cell", "salt", "root").join(names, "root"), ["cell", "salt", "root"]).select(key, "first", "size", "similarity")


def _matrix(packed: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float32).reshape(len(packed), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def typical_members(groups: DataFrame, key: str, n: int = 3) -> DataFrame:
    """``(first, size, rank, key, distance)``: the n members of each group nearest its centroid; ties go to the smaller key."""
    nearest = Window.partitionBy("first").orderBy("distance", key)
    return (
        groups.select("first", "size", key, F.round(1.0 - F.col("similarity"), 6).alias("distance"))
        .withColumn("rank", F.row_number().over(nearest))
        .where(F.col("rank") <= n)
        .select("first", "size", "rank", key, "distance")
    )
