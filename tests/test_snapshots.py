import datetime as dt

import pytest

from lacuna.operators import snapshots

SCHEMA = "dataset_name string, timestamp string, coverage_score double, gaps array<struct<name:string,priority_score:double,type:string>>, delivered_at timestamp_ntz, change string"
T0 = dt.datetime(2024, 1, 1)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clashing name") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in snapshots.coverage_changes(df).collect())


def gap(name, score=1.0, kind="category"):
    return (name, score, kind)


def test_added_removed_changed_and_score(spark):
    got = run(
        spark,
        [
            ("d", "2024-01-01T00:00:00", 0.5, [gap("A b"), gap("gone"), gap("same", 1.001)], T0),
            ("d", "2024-01-02T00:00:00+01:00", 0.6, [gap(" a  B ", 2.0), gap("new"), gap("SAME", 1.0)], T0),
        ],
    )
    at = "2024-01-01T23:00:00"
    assert got == [("d", at, "category", "a b", "changed"), ("d", at, "category", "gone", "removed"), ("d", at, "category", "new", "added"), ("d", at, "run", "coverage_score", "changed")]


def test_null_gaps_do_not_count_and_empty_ones_do(spark):
    rows = [("d", "20240101-000000", 0.5, [gap("x")], T0), ("d", "20240102-000000", 0.9, None, T0), ("d", "20240103-000000", 0.5, [], T0)]
    assert run(spark, rows) == [("d", "2024-01-03T00:00:00", "category", "x", "removed")]


def test_latest_delivery_counts_and_copies_once(spark):
    later = T0 + dt.timedelta(days=1)
    rows = [
        ("d", "2024-01-01 00:00:00", 0.5, [gap("x"), gap("x")], T0), ("d", "2024-01-02T00:00:00Z", 0.5, [gap("y")], T0),
        ("d", "2024-01-02T00:00:00", 0.5, [gap("x", None)], later), ("d", "2024-01-02T00:00:00", 0.5, [gap("x", None)], later),
    ]
    assert run(spark, rows) == [("d", "2024-01-02T00:00:00", "category", "x", "changed")]


def test_nameless_null_and_unplaced_rows(spark):
    rows = [
        ("d", "2024-01-01T00:00:00", None, [gap(None), gap(" \t"), None, gap("k", None, None)], T0), ("d", "2024-02-01T00:00:00", None, [], T0),
        (None, "2024-01-01T00:00:00", 1.0, [gap("z")], T0), ("d", "no time", 1.0, [gap("z")], T0), ("d", None, 1.0, [gap("z")], T0),
    ]
    assert run(spark, rows) == [("d", "2024-02-01T00:00:00", None, "k", "removed")]


def test_empty(spark):
    assert run(spark, []) == []


def test_many_buckets_equal_plain_order(spark):
    """A long series cut into buckets is linked as if it were sorted whole."""
    days = [T0 + dt.timedelta(days=3 * i, hours=i % 5) for i in range(200)]
    rows = [("d", d.isoformat(), 0.5, [gap(f"g{i}")], T0) for i, d in enumerate(days)]
    got = run(spark, rows)
    want = sorted(x for i in range(1, 200) for x in (("d", days[i].isoformat(), "category", f"g{i}", "added"), ("d", days[i].isoformat(), "category", f"g{i - 1}", "removed")))
    assert got == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-03-01T12:00:00", "2024-03-01T12:00:00"), ("2024-03-01T12:00:00Z", "2024-03-01T12:00:00"), ("2024-03-01 12:00:00.250", "2024-03-01T12:00:00"),
        ("20240301-120000", "2024-03-01T12:00:00"), ("2024-03-01T12:00:00-05:00", "2024-03-01T17:00:00"), ("2024-03-01T12:00:00+0200", "2024-03-01T10:00:00"),
        (" 1969-12-31T23:59:59.5Z ", "1969-12-31T23:59:59"), ("yesterday", None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants(spark, text, want, zone):
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(text,)], "t string").select(snapshots.utc_text(snapshots.instant_micros(F.col("t"))))
        assert df.first()[0] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
