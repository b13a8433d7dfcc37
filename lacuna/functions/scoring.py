"""Scores and classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna import config


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gap_priority(distance: Column, expected: Column, isolation: Column, weights: tuple[float, float, float] = config.PRIORITY_WEIGHTS) -> Column:
    """0..100: weighted mean of distance, being expected, and isolation; 0 where the weights add up to nothing."""
    total = float(sum(weights))
    if total <= 0:
        return F.lit(0.0)
    wd, we, wi = (float(w) for w in weights)
    mean = (clip01(distance) * wd + expected.cast("double") * we + clip01(isolation) * wi) / total
    return F.round(mean * 100.0, 2)


def cluster_health(size: Column, cluster: Column) -> Column:
    return (
        F.when(cluster == config.NOISE, "noise").when(size < config.SPARSE_THRESHOLD, "sparse").when(size <= config.THIN_MAX, "thin").otherwise("well-covered")
    )


def health_colour(health: Column) -> Column:
    colours = F.create_map(*[F.lit(x) for pair in sorted(config.HEALTH_COLOURS.items()) for x in pair])
    return colours[health]


def coverage_quality(percent: Column) -> Column:
    out = None
    for below, name in config.COVERAGE_BANDS:
        out = F.when(percent < below, name) if out is None else out.when(percent < below, name)
    return out.otherwise(config.COVERAGE_TOP)


def severity(priority: Column) -> Column:
    return F.when(priority > config.SEVERITY_CRITICAL_ABOVE, "Critical").when(priority >= config.SEVERITY_MODERATE_FROM, "Moderate").otherwise("Low")


def collection_target(kind: Column, priority: Column, count: Column) -> Column:
    """How many items to collect: by severity; for a sparse cluster at least what fills it up."""
    by = severity(priority)
    target = F.when(by == "Critical", config.TARGETS["Critical"]).when(by == "Moderate", config.TARGETS["Moderate"]).otherwise(config.TARGETS["Low"])
    return F.when(kind == "category", target).otherwise(F.greatest(target, F.lit(config.THIN_MAX) - F.coalesce(count, F.lit(0)))).cast("int")


def trend(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")


def is_generic_label(label: Column, cluster: Column) -> Column:
    """Whether a label is missing or a placeholder."""
    own = F.concat(F.lit("Cluster "), cluster.cast("string"))
    return F.coalesce(label, F.lit("")).isin("", config.NOISE_LABEL) | F.coalesce(label == own, F.lit(False))


def is_rate_limit(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("429|rate|too many"), F.lit(False))


def adaptive_k(n: Column, n_truth: Column) -> Column:
    """Clusters to ask for: 1 below four rows, else at least 2, at most a third of the rows and the known classes."""
    return F.when(n < 4, 1).otherwise(F.greatest(F.lit(2), F.least(n_truth, F.greatest(F.lit(2), F.floor(n / 3))))).cast("long")
