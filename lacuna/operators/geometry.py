"""2-D geometry: grid coverage, density grid, hull, Voronoi coverage, areas, drawing coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna import config
from lacuna.functions import vectors as vec


def points(rows: DataFrame) -> DataFrame:
    """``(x, y)`` of the rows with a finite position."""
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(vec.INF)) for c in ("umap_x", "umap_y")]
    return rows.where(ok[0] & ok[1]).select(F.col("umap_x").alias("x"), F.col("umap_y").alias("y"))


def grid_coverage(xy: DataFrame, grid: int = config.COVERAGE_GRID) -> DataFrame:
    """One row ``(cells, coverage)``: share of grid cells that hold a point, over the range padded by 1 %; 0 without a range."""
    r = xy.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = lambda lo, hi: (F.col(hi) - F.col(lo)) * 0.01
    cell = lambda c, lo, hi: F.least(F.lit(grid - 1), F.floor((F.col(c) - (F.col(lo) - pad(lo, hi))) / ((F.col(hi) - F.col(lo) + 2 * pad(lo, hi)) / grid)))
    cells = xy.crossJoin(F.broadcast(r)).where("x1 > x0 AND y1 > y0").select((cell("x", "x0", "x1") * grid + cell("y", "y0", "y1")).alias("c"))
    return cells.agg(F.countDistinct("c").alias("cells")).select("cells", (F.col("cells") / F.lit(float(grid * grid))).alias("coverage"))


def kde_grid(xy: DataFrame, grid: int = config.KDE_GRID) -> DataFrame:
    """``(i, j, x, y, density)``: Gaussian kernel density on a grid over the range padded by 10 % (1.0 without range).

    Bandwidth: sample covariance times n^(-1/3). Fewer than four points or no spread: no rows. The points
    stay distributed; each task adds up its points on the whole grid and sends one grid.
    """
    s = xy.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"),
    ).first()
    schema = "i int, j int, x double, y double, density double"
    if s["n"] < 4 or min(s["vx"], s["vy"]) < 1e-18 or s["vx"] * s["vy"] - s["vxy"] ** 2 <= 0:
        return xy.sparkSession.createDataFrame([], schema)
    px, py = ((s["x1"] - s["x0"]) * 0.1 or 1.0), ((s["y1"] - s["y0"]) * 0.1 or 1.0)
    gx, gy = np.linspace(s["x0"] - px, s["x1"] + px, grid), np.linspace(s["y0"] - py, s["y1"] + py, grid)
    f = s["n"] ** (-1.0 / 3.0)
    a, b, c = s["vx"] * f, s["vxy"] * f, s["vy"] * f
    det = a * c - b * b
    scale = 1.0 / (2 * np.pi * np.sqrt(det) * s["n"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((grid, grid))
        for batch in batches:
            for k in range(0, len(batch), 512):
                x, y = batch["x"].to_numpy()[k : k + 512], batch["y"].to_numpy()[k : k + 512]
                dx, dy = gx[:, None] - x[None, :], gy[:, None] - y[None, :]
                # exp of a sum of three terms, two of which depend on one axis only
                cross = np.einsum("ip,jp->ijp", dx, dy) * (b / det)
                e = -0.5 * (c / det) * dx[:, None, :] ** 2 - 0.5 * (a / det) * dy[None, :, :] ** 2 + cross
                total += np.exp(e).sum(axis=2)
        i, j = np.divmod(np.arange(grid * grid), grid)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "x": gx[i], "y": gy[j], "density": total.ravel() * scale})

    return xy.mapInPandas(add, schema).groupBy("i", "j", "x", "y").agg(F.sum("density").alias("density"))


def polygon_area(vertices: Column) -> Column:
    """Area of ``ARRAY<STRUCT<x, y>>`` by the shoelace rule; 0 with fewer than three vertices."""
    shifted = F.concat(F.slice(vertices, 2, F.greatest(F.lit(0), F.size(vertices) - 1)), F.slice(vertices, 1, 1))
    twice = F.aggregate(F.zip_with(vertices, shifted, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, t: s + t)
    return F.when(F.size(vertices) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def area(v: np.ndarray) -> float:
    if len(v) < 3:
        return 0.0
    x, y = v[:, 0], v[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def hull(p: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, counter-clockwise from the leftmost (monotone chain)."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(half(p)[:-1] + half(p[::-1])[:-1])


def convex_hull(xy: DataFrame) -> DataFrame:
    """``(ord, x, y)``: the hull of all points; each task sends the hull of its own points, one task merges them."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, 2))
        for b in batches:
            kept = hull(np.concatenate([kept, b[["x", "y"]].to_numpy(float)]))
        yield pd.DataFrame(kept, columns=["x", "y"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        v = hull(pdf[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"ord": np.arange(len(v), dtype=np.int32), "x": v[:, 0], "y": v[:, 1]})

    return xy.mapInPandas(part, "x double, y double").groupBy(F.lit(0).alias("_all")).applyInPandas(whole, "ord int, x double, y double")


def clip(poly: np.ndarray, mid: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """The part of a convex polygon on the side of ``mid`` away from ``normal``."""
    side = (poly - mid) @ normal
    if (side <= 0).all():
        return poly
    out = []
    for i in range(len(poly)):
        j = (i + 1) % len(poly)
        if side[i] <= 0:
            out.append(poly[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(poly[i] + (poly[j] - poly[i]) * (side[i] / (side[i] - side[j])))
    return np.array(out) if out else np.zeros((0, 2))


class Neighbours:
    """Points in a grid of buckets, met ring by ring around a place."""

    def __init__(self, p: np.ndarray, per_cell: int = 4):
        self.p, self.low = p, p.min(axis=0)
        n = max(1, int(np.sqrt(len(p) / per_cell)))
        self.step = max(float((p.max(axis=0) - self.low).max()) / n, 1e-300)
        cell = ((p - self.low) / self.step).astype(int)
        self.reach = int(cell.max()) + 1
        order = np.lexsort((cell[:, 1], cell[:, 0]))
        self.at: dict[tuple[int, int], np.ndarray] = {}
        keys, starts = np.unique(cell[order], axis=0, return_index=True)
        for key, part in zip(map(tuple, keys.tolist()), np.split(order, starts[1:])):
            self.at[key] = part

    def rings(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """``(distance that points of this ring or later have at least, points of the ring)``."""
        cx, cy = ((q - self.low) / self.step).astype(int)
        for r in range(self.reach + 1):
            ring = [(cx + dx, cy + dy) for dx in range(-r, r + 1) for dy in ((-r, r) if abs(dx) < r else range(-r, r + 1))] if r else [(cx, cy)]
            found = [self.at[c] for c in ring if c in self.at]
            yield (r - 1) * self.step, np.concatenate(found) if found else np.zeros(0, int)


def cell_area(i: int, p: np.ndarray, outer: np.ndarray, near: Neighbours) -> float:
    """Area of the Voronoi cell of point i within the hull: cut by the bisectors with the points around, nearest rings first.

    It ends when the points still to come are more than twice as far as the farthest vertex.
    """
    poly, q = outer, p[i]
    for safe, found in near.rings(q):
        reach = np.sqrt(((poly - q) ** 2).sum(axis=1).max())
        if safe > 2 * reach:
            break
        gap = p[found] - q
        d = (gap**2).sum(axis=1)
        for k in np.argsort(d, kind="stable"):
            if found[k] != i and d[k] <= 4 * reach * reach:
                poly = clip(poly, q + gap[k] / 2, gap[k])
                if len(poly) < 3:
                    return 0.0
                reach = np.sqrt(((poly - q) ** 2).sum(axis=1).max())
    return area(poly)


#: Different positions broadcast for Voronoi cells (16 bytes each); more are refused rather than dropped.
MAX_SITES = 4_000_000


def voronoi_coverage(xy: DataFrame, factor: float = config.VORONOI_FACTOR) -> DataFrame:
    """One row ``(cells, hull_area, coverage)``: area of cells under factor * median area, as a share of the hull.

    Equal positions are one site. 0 with fewer than four points or a flat hull. Cells are independent:
    the sites (bounded by ``MAX_SITES``) are broadcast and each task cuts its own cells from the hull.
    """
    spark = xy.sparkSession
    sites = xy.distinct()
    n = xy.count()
    outer = np.array([(r["x"], r["y"]) for r in convex_hull(xy).orderBy("ord").collect()]).reshape(-1, 2)
    whole = area(outer)
    if n < 4 or whole <= 0:
        return spark.createDataFrame([(0, float(whole), 0.0)], "cells long, hull_area double, coverage double")
    if sites.count() > MAX_SITES:
        raise ValueError(f"voronoi_coverage takes at most {MAX_SITES} different positions; use grid_coverage")
    p = sites.toPandas().sort_values(["x", "y"])[["x", "y"]].to_numpy(float)
    sent = spark.sparkContext.broadcast((p, outer))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = None
        for b in batches:
            pts, border = sent.value
            near = near or Neighbours(pts)
            yield pd.DataFrame({"area": [cell_area(int(i), pts, border, near) for i in b["id"]]})

    areas = spark.range(len(p)).mapInPandas(cells, "area double").where("area > 0").persist()
    bound = areas.agg(F.median("area").alias("m"))
    dense = areas.crossJoin(F.broadcast(bound)).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.col("area") < factor * F.col("m"), F.col("area"))).alias("dense"))
    return dense.select("cells", F.lit(float(whole)).alias("hull_area"), F.least(F.lit(1.0), F.coalesce("dense", F.lit(0.0)) / whole).alias("coverage"))


#: Drawing size and its margins left, right, top, bottom.
DRAWING, MARGINS = (900, 520), (50, 180, 20, 48)


def svg_position(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sx, sy``: linear map of the range into the drawing, y upwards; the centre without a range."""
    left, right, top, bottom = MARGINS
    w, h = DRAWING[0] - left - right, DRAWING[1] - top - bottom
    r = rows.agg(F.min("umap_x").alias("_x0"), F.max("umap_x").alias("_x1"), F.min("umap_y").alias("_y0"), F.max("umap_y").alias("_y1"))
    sx = F.when(F.col("_x1") > F.col("_x0"), left + (F.col("umap_x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * w).otherwise(F.lit(left + w / 2.0))
    up = (F.col("umap_y") - F.col("_y0")) / (F.col("_y1") - F.col("_y0"))
    sy = F.when(F.col("_y1") > F.col("_y0"), top + (1.0 - up) * h).otherwise(F.lit(top + h / 2.0))
    return rows.crossJoin(F.broadcast(r)).withColumn("sx", sx).withColumn("sy", sy).drop("_x0", "_x1", "_y0", "_y1")


def marker_size(rows: DataFrame) -> DataFrame:
    """``rows`` with ``marker``: 6 to 14 by distance to the centroid, relative to the greatest (at least 0.001)."""
    top = rows.agg(F.greatest(F.max("centroid_distance"), F.lit(0.001)).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("marker", 6.0 + 8.0 * F.coalesce("centroid_distance", F.lit(0.0)) / F.col("_top")).drop("_top")
