"""Queries of the general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.operators import snapshots
from lacuna.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.coverage_changes(table(spark, folder, "coverage_history"))


QUERIES = {"p3_found": p3_found}

ORACLE = {
    "p3_found": r"""
WITH raw AS (
  SELECT dataset_name, coverage_score, gaps, delivered_at,
         regexp_replace(trim("timestamp"), '^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})', '\1-\2-\3T\4:\5:\6') AS t
  FROM coverage_history WHERE gaps IS NOT NULL AND dataset_name IS NOT NULL),
placed AS (
  SELECT dataset_name, coverage_score, gaps, delivered_at,
         CAST(substr(replace(t, ' ', 'T'), 1, 19) AS TIMESTAMP)
         - CASE WHEN regexp_matches(t, '[+-]\d{2}:\d{2}$')
                THEN to_minutes(CAST((CASE WHEN substr(right(t, 6), 1, 1) = '-' THEN -1 ELSE 1 END)
                     * (CAST(substr(right(t, 6), 2, 2) AS INTEGER) * 60 + CAST(right(t, 2) AS INTEGER)) AS BIGINT))
                ELSE to_minutes(CAST(0 AS BIGINT)) END AS instant
  FROM raw),
snaps AS (
  SELECT dataset_name, instant, coverage_score, gaps FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset_name, instant ORDER BY delivered_at DESC NULLS LAST) AS rn FROM placed)
  WHERE rn = 1),
linked AS (
  SELECT *, lead(instant) OVER w AS next_at, lag(instant) OVER w AS prev_at FROM snaps
  WINDOW w AS (PARTITION BY dataset_name ORDER BY instant)),
items AS (
  SELECT dataset_name, instant, next_at, prev_at, 'run' AS gap_type, 'coverage_score' AS gap_name, round(coverage_score, 4) + 0.0::DOUBLE AS val FROM linked
  UNION ALL
  SELECT dataset_name, instant, next_at, prev_at, g."type", trim(lower(regexp_replace(g."name", '[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))), round(g.priority_score, 2) + 0.0::DOUBLE
  FROM (SELECT dataset_name, instant, next_at, prev_at, unnest(gaps) AS g FROM linked)),
named AS (SELECT * FROM items WHERE gap_name <> ''),
sides AS (
  SELECT dataset_name, instant AS snap, gap_type, gap_name, 'new' AS side, val FROM named WHERE prev_at IS NOT NULL
  UNION ALL
  SELECT dataset_name, next_at, gap_type, gap_name, 'old', val FROM named WHERE next_at IS NOT NULL),
grouped AS (
  SELECT dataset_name, snap, gap_type, gap_name,
         count(*) FILTER (WHERE side = 'new') AS n_new, count(*) FILTER (WHERE side = 'old') AS n_old,
         max(val) FILTER (WHERE side = 'new') AS v_new, max(val) FILTER (WHERE side = 'old') AS v_old
  FROM sides GROUP BY ALL)
SELECT dataset_name, strftime(snap, '%Y-%m-%dT%H:%M:%S') AS snapshot_at, gap_type, gap_name,
       CASE WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'removed' ELSE 'changed' END AS change
FROM grouped WHERE n_old = 0 OR n_new = 0 OR v_new IS DISTINCT FROM v_old
""",
}
