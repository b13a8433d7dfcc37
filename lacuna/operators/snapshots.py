"""What changed between consecutive full snapshots of a table.

Both snapshots of every consecutive pair are unioned, tagged by side, grouped by key, and each key is
classified from one hash per side in a single aggregation shuffle. Nothing is joined pair-wise, so a
snapshot of any size costs two rows per item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds of history that one window task sorts; a hot dataset is cut into that many-second buckets.
BUCKET_SECONDS = 7 * 86400


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 (UTC) of an ISO-like text; null where it names no instant.

    Understands ``yyyy-MM-dd[T ]HH:mm[:ss[.f]]`` and ``yyyyMMdd-HHmmss``, each with or without an
    offset; without one the text is UTC, whatever the session's time zone.
    """
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})[-T ](\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    t = F.when(t.rlike(r"(?i)(z|[+-]\d{2}:\d{2}(:\d{2})?)$") & t.rlike(r"\d[T ]\d"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(t.try_cast("timestamp"))


def utc_text(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of microseconds since 1970, independent of the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000
    return F.date_format(epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds), "yyyy-MM-dd'T'HH:mm:ss")


def tidy_name(name: Column) -> Column:
    """Lower case, runs of white space (Unicode, no-break included) as one blank, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", " "), "^ | $", ""))


def consecutive(df: DataFrame, series: str, at: str, bucket: str) -> DataFrame:
    """Adds ``_next`` (the next ``at`` in the series or null) and ``_first`` to rows unique in (series, at).

    ``df`` must be partitioned by (series, bucket), bucket rising with ``at``. The order inside a bucket
    comes from a window over the bucket, the step to the next bucket from a window over one row per
    bucket. So a series that holds a third of all rows is sorted in many tasks.
    """
    inside = Window.partitionBy(series, bucket).orderBy(at)
    ordered = df.withColumn("_in_next", F.lead(at).over(inside)).withColumn("_in_first", F.row_number().over(inside) == 1)
    across = Window.partitionBy(series).orderBy(bucket)
    edges = (
        df.groupBy(series, bucket)
        .agg(F.min(at).alias("_min"))
        .withColumn("_after", F.lead("_min").over(across))
        .withColumn("_earliest", F.row_number().over(across) == 1)
        .drop("_min")
    )
    return (
        ordered.join(edges, [series, bucket])
        .withColumn("_next", F.coalesce("_in_next", "_after"))
        .withColumn("_first", F.col("_in_first") & F.col("_earliest"))
        .drop("_in_next", "_in_first", "_after", "_earliest")
    )


def classify(items: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """``keys + change`` from rows tagged ``new`` or ``old``: added, removed or changed.

    One aggregation: the presence and the hash of each side. Repeated items of a side count once, with
    their greatest value (nulls only if all are null). A null value differs from any other.
    """
    new, old = F.col(side) == "new", F.col(side) == "old"
    sides = items.groupBy(*keys).agg(
        F.max(new.cast("int")).alias("_new"),
        F.max(old.cast("int")).alias("_old"),
        F.xxhash64(F.max(F.when(new, F.col(value)))).alias("_new_hash"),
        F.xxhash64(F.max(F.when(old, F.col(value)))).alias("_old_hash"),
    )
    change = (
        F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "removed").when(F.col("_new_hash") != F.col("_old_hash"), "changed")
    )
    return sides.select(*keys, change.alias("change")).where("change IS NOT NULL")


def coverage_changes(history: DataFrame) -> DataFrame:
    """``(dataset_name, snapshot_at, gap_type, gap_name, change)`` between consecutive snapshots of a dataset.

    - Snapshots with null ``gaps`` do not count; an empty array does (everything was closed). Rows
      without a dataset name or a readable timestamp cannot be placed and are left out.
    - Of several deliveries of a dataset and instant the latest ``delivered_at`` counts (null is the
      oldest); equal deliveries count once, chosen by a hash of their content.
    - The first snapshot of a dataset has no changes. Gaps are keyed by type (null is a type) and tidied
      name; nameless gaps do not count; a gap listed twice counts once.
    - ``changed``: the score rounded to 2 decimals differs; for the run's ``coverage_score`` 4 decimals.
      Not-a-number differs from a number and from null.
    - An empty table gives an empty result; other columns are ignored, so clashing names are harmless.
    """
    body = F.struct("coverage_score", "gaps")
    micros = instant_micros(F.col("timestamp"))
    placed = (
        history.where(F.col("gaps").isNotNull() & F.col("dataset_name").isNotNull())
        .select("dataset_name", micros.alias("_at"), "coverage_score", "gaps", "delivered_at")
        .where("_at IS NOT NULL")
        .withColumn("_bucket", F.floor(F.col("_at") / F.lit(BUCKET_SECONDS * 1_000_000)))
        .repartition("dataset_name", "_bucket")
    )
    snapshots = (
        placed.groupBy("dataset_name", "_bucket", "_at")
        .agg(F.max_by(body, F.struct("delivered_at", F.xxhash64("coverage_score", "gaps"))).alias("_s"))
        .select("dataset_name", "_bucket", "_at", F.col("_s.coverage_score").alias("_score"), F.col("_s.gaps").alias("_gaps"))
    )
    linked = consecutive(snapshots, "dataset_name", "_at", "_bucket")
    run = F.struct(F.lit("run").alias("gap_type"), F.lit("coverage_score").alias("gap_name"), (F.round("_score", 4) + 0.0).alias("_value"))
    gaps = F.transform(
        F.filter("_gaps", lambda g: g.isNotNull()),
        lambda g: F.struct(g["type"].alias("gap_type"), tidy_name(g["name"]).alias("gap_name"), (F.round(g["priority_score"], 2) + 0.0).alias("_value")),
    )
    sides = F.filter(
        F.array(
            F.struct(F.lit("new").alias("side"), F.when(~F.col("_first"), F.col("_at")).alias("snap")),
            F.struct(F.lit("old").alias("side"), F.col("_next").alias("snap")),
        ),
        lambda s: s["snap"].isNotNull(),
    )
    items = (
        linked.select("dataset_name", F.concat(F.array(run), gaps).alias("_items"), sides.alias("_sides"))
        .select("dataset_name", "_sides", F.explode("_items").alias("_i"))
        .where("_i.gap_name <> ''")
        .select("dataset_name", "_i.*", F.explode("_sides").alias("_s"))
        .select("dataset_name", F.col("_s.snap").alias("_snap"), "gap_type", "gap_name", F.col("_s.side").alias("_side"), "_value")
    )
    changes = classify(items, ["dataset_name", "_snap", "gap_type", "gap_name"], "_side", "_value")
    return changes.select("dataset_name", utc_text(F.col("_snap")).alias("snapshot_at"), "gap_type", "gap_name", "change")
