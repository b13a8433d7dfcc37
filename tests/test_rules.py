"""Rules with their boundary points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import config
from lacuna.functions import scoring, text
from lacuna.operators import embedding, gaps, geometry


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bands_and_severity(spark):
    points = [0.0, 29.9, 30.0, 54.9, 55.0, 79.9, 80.0, 100.0]
    assert values(spark, [(p,) for p in points], "p double", scoring.coverage_quality(F.col("p"))) == ["Poor"] * 2 + ["Fair"] * 2 + ["Good"] * 2 + ["Excellent"] * 2
    points = [0.0, 39.9, 40.0, 70.0, 70.1, 100.0]
    assert values(spark, [(p,) for p in points], "p double", scoring.severity(F.col("p"))) == ["Low"] * 2 + ["Moderate"] * 2 + ["Critical"] * 2


def test_health(spark):
    rows = [(0, 1), (2, 1), (3, 1), (5, 1), (6, 1), (50, 1), (50, -1)]
    got = values(spark, rows, "s long, c int", scoring.cluster_health(F.col("s"), F.col("c")))
    assert got == ["sparse", "sparse", "thin", "thin", "well-covered", "well-covered", "noise"]


def test_priority(spark):
    row = [(0.98, True, 1.0), (0.0, False, 1.0), (5.0, True, -3.0)]
    schema = "d double, e boolean, i double"
    p = lambda w: scoring.gap_priority(F.col("d"), F.col("e"), F.col("i"), w)
    assert values(spark, row, schema, p(config.PRIORITY_WEIGHTS)) == [99.0, 20.0, 80.0]
    assert values(spark, row, schema, p((1, 0, 0))) == [98.0, 0.0, 100.0]
    assert values(spark, row, schema, p((0, 0, 0))) == [0.0] * 3


@pytest.mark.parametrize(
    "line, want",
    [
        ("a: x, y | b: z", [("a", ["x", "y"]), ("b", ["z"])]), ("x, y", [("x", ["x"]), ("y", ["y"])]), ("a | b: ", [("a", ["a"]), ("b", ["b"])]), ("a, b | c: d", [("a, b", ["a, b"]), ("c", ["d"])]),
        (" : x | a: b: c", [("a", ["b: c"])]), ("", []), ("  ", []), ("a:\u00a0x ,, y", [("a", ["x", "y"])]),
    ],
)
def test_hierarchy_text(spark, line, want):
    got = {}
    for r in gaps.parse_hierarchy(spark, line).orderBy("parent_ord", "child_ord").collect():
        got.setdefault((r["parent_ord"], r["parent"]), []).append(r["child"])
    assert [(p, c) for (_, p), c in got.items()] == want


@pytest.mark.parametrize(
    "answer, want",
    [
        ("COMMON: dogs run\nVARIATION: breed", ("dogs run", "breed")), ("**Common:** dogs\nrun\n\n**Variation:**\nbreed\nsize", ("dogs run", "breed size")), ("just text\nmore", ("just text\nmore", "")),
        ("variation: only this", ("", "only this")), ("intro\ncommon: x", ("x", "")), ("COMMON:\nVARIATION:", ("COMMON:\nVARIATION:", "")), ("", ("", "")), (None, ("", "")),
    ],
)
def test_description(answer, want):
    assert text.parse_description(answer) == want


def test_text_rules(spark):
    rows = [("abcdef",), ("abc",), (None,), ("",)]
    assert values(spark, rows, "t string", text.truncate(F.col("t"), 4)) == ["abc…", "abc", None, ""]
    assert values(spark, [("a b/ü-1_",), ("",), (None,)], "t string", text.safe_name(F.col("t"))) == ["a_b_ü-1_", "unnamed", "unnamed"]
    got = values(spark, [(["A", "a ", "b", "B", " ", "c"],), ([],)], "t array<string>", text.dedup_phrases(F.col("t")))
    assert got == [["A", "b", "c"], []]


def test_retry_waits_and_gives_up():
    for fails, waits in ((0, []), (2, [2.0, 4.0]), (9, [2.0, 4.0, 8.0])):
        calls, slept = [], []

        def call():
            calls.append(1)
            if len(calls) <= fails:
                raise RuntimeError(str(len(calls)))
            return "ok"

        if fails > 3:
            with pytest.raises(RuntimeError, match="4"):
                embedding.with_retries(call, sleep=slept.append)
        else:
            assert embedding.with_retries(call, sleep=slept.append) == "ok"
        assert slept == waits and len(calls) == min(fails, 3) + 1


def test_hull_and_cells():
    rng = np.random.default_rng(0)
    p = rng.standard_normal((150, 2))
    outer = geometry.hull(p)
    near = geometry.Neighbours(p)
    cells = [geometry.cell_area(i, p, outer, near) for i in range(len(p))]
    assert np.isclose(sum(cells), geometry.area(outer))
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5), (0.5, 0)], float)
    assert np.isclose(geometry.area(geometry.hull(square)), 1.0) and len(geometry.hull(square)) == 4


def test_coverage_of_odd_inputs(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "x double, y double")
    for df in (line, line.limit(3), line.where("false")):
        assert geometry.voronoi_coverage(df).first()["coverage"] == 0.0
        assert geometry.kde_grid(df).count() == 0
    one = spark.createDataFrame([(1.0, 1.0)] * 9, "x double, y double")
    assert geometry.grid_coverage(one).first()["coverage"] == 0.0


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    xy = spark.createDataFrame([(float(a), float(b)) for a, b in rng.standard_normal((400, 2))], "x double, y double")
    g = geometry.kde_grid(xy, 80).toPandas()
    step = (g["x"].max() - g["x"].min()) / 79 * (g["y"].max() - g["y"].min()) / 79
    assert 0.9 < g["density"].sum() * step < 1.01
