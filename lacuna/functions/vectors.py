"""Vector maths as Column expressions (JVM side) and as numpy block helpers (Arrow side)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def usable(vec: Column, dim: int = 64) -> Column:
    """True for vectors of ``dim`` finite numbers that are not all zero; false (never null) otherwise."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF)))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the arrays differ in length or hold nulls."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    # the norm travels beside the values: inside their lambda it would be computed once for each of them
    n = norm(a)
    held = F.array(F.struct(F.when(n > 0, n).otherwise(F.lit(1.0)).alias("n"), a.alias("a")))
    return F.when(a.isNotNull(), F.transform(held, lambda s: F.transform(s["a"], lambda x: x.cast("double") / s["n"]))[0])


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0.0 where one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, held within [0, 2]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - cosine_similarity(a, b)))


def matrix(series: pd.Series, dtype=np.float64) -> np.ndarray:
    """Rows of an array column as one matrix (0 x 0 when empty)."""
    return np.array(series.tolist(), dtype=dtype) if len(series) else np.zeros((0, 0), dtype)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest value first so that extreme values cannot overflow."""
    if not m.size:
        return m
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)
