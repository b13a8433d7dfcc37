"""Queries of the llm problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, dedup, grouping, ivfpq, packing, subset, topn, truncation
from lacuna.runtime import Scratch, spread
from lacuna.sources import tables
from lacuna.sources.tables import table


def _current_vectors(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    """``(sample_id, v)``: unit vectors of the current samples with a usable embedding, as a written table."""
    rows = tables.current_samples(table(spark, folder, "samples"), ["sample_id", "embedding"])
    return scratch.write(tables.usable_vectors(rows, "sample_id", "embedding"), "vectors")


def p1_subset(spark: SparkSession, folder: str) -> DataFrame:
    """``(target_name, sample_id)``: as many samples as each row of size_targets in samples says."""
    targets = table(spark, folder, "size_targets").where("unit = 'samples'").select("target_name", F.col("amount").alias("size"))
    sizes = [r[0] for r in targets.select("size").distinct().collect()]
    chosen = subset.varied_subset(_current_vectors(spark, folder, Scratch(spark)), "sample_id", sizes)
    return chosen.join(F.broadcast(targets), "size").select("target_name", "sample_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    groups = grouping.similarity_groups(_current_vectors(spark, folder, scratch), "sample_id", scratch, 0.8)
    return groups.where("size > 1").select(F.col("first").alias("first_sample_id"), "sample_id")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each group by its size and its three most typical samples."""
    scratch = Scratch(spark)
    groups = grouping.similarity_groups(_current_vectors(spark, folder, scratch), "sample_id", scratch, 0.8)
    return grouping.typical_members(groups, "sample_id", 3).withColumnRenamed("first", "first_sample_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries one after another against the history and those before: the store is filled once, then opened again and appended to."""
    at = Scratch(spark).path("store")
    dedup.FingerprintStore.create(table(spark, folder, "embedding_cache"), at).close()
    return dedup.accept_all(at, table(spark, folder, "embedding_batches"), 0.95)


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark)
    return ivfpq.most_similar(_current_vectors(spark, folder, scratch), "sample_id", 3, scratch, spent="vectors")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = ivfpq.similar_pairs(_neighbours(spark, folder), "sample_id", 0.8)
    return pairs.select(F.col("a").alias("sample_id_a"), F.col("b").alias("sample_id_b"))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The three most similar samples of every sample."""
    return _neighbours(spark, folder).select("sample_id", "rank", F.col("other").alias("similar_id"), "similarity")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = Scratch(spark).write(
        tables.current_samples(table(spark, folder, "samples"), ["sample_id", "cluster_id", "centroid_distance"]), "current"
    )
    return topn.nearest_in_cluster(rows, 3).select("cluster_id", "sample_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each post in a container of each token capacity of size_targets; sizes by byte_bpe_50k."""
    scratch = Scratch(spark)
    targets = {r[0]: int(r[1]) for r in table(spark, folder, "size_targets").where("unit = 'tokens' AND amount > 0").select("target_name", "amount").collect()}
    posts = spread(table(spark, folder, "documents").select("doc_id", "text"))
    sizes = scratch.write(bpe.count_tokens(posts, "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "tokens", targets, scratch)


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    posts = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return truncation.truncated(posts, "doc_id", Scratch(spark))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).where("cut").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut posts per source."""
    return truncation.rates(_verdicts(spark, folder))


QUERIES = {"p1_subset": p1_subset, "p2_found": p2_found, "p2_groups": p2_groups, "p4_found": p4_found, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p9_found": p9_found, "p9_rates": p9_rates}

_CURRENT = """
current_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM samples WHERE sample_id IS NOT NULL)
  WHERE rn = 1)"""

_USABLE = """
usable AS (
  SELECT sample_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (
    SELECT sample_id, embedding AS e FROM current_rows WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0))"""

ORACLE = {
    "p2_found": f"""
WITH {_CURRENT}, {_USABLE},
near AS (
  SELECT a.sample_id, min(b.sample_id) AS first_sample_id, count(*) AS size
  FROM usable a JOIN usable b ON list_dot_product(a.v, b.v) >= 0.8 GROUP BY a.sample_id)
SELECT first_sample_id, sample_id FROM near WHERE size > 1
""",
    "p4_found": """
WITH entries AS (
  SELECT entry_id, nullif(lower(trim(regexp_replace(file_hash, '\\s+', ' ', 'g'))), '') AS h, embedding AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY file_hash) AS rn FROM embedding_batches) WHERE rn = 1),
earlier AS (
  SELECT -1 AS seq, nullif(lower(trim(regexp_replace(file_hash, '\\s+', ' ', 'g'))), '') AS h, embedding AS e FROM embedding_cache
  UNION ALL SELECT entry_id, h, e FROM entries),
vectors AS (
  SELECT seq, CAST(e AS DOUBLE[]) AS v FROM earlier
  WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(e, lambda x: x <> 0)) > 0),
units AS (SELECT seq, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vectors)
SELECT a.entry_id FROM entries a JOIN earlier b ON a.h = b.h AND b.seq < a.entry_id
UNION
SELECT a.seq AS entry_id FROM units a JOIN units b ON a.seq >= 0 AND b.seq < a.seq AND list_dot_product(a.u, b.u) >= 0.95
""",
    "p5_found": f"""
WITH {_CURRENT}, {_USABLE},
pairs AS (
  SELECT a.sample_id AS a, b.sample_id AS b, round(list_dot_product(a.v, b.v), 6) AS s FROM usable a JOIN usable b ON a.sample_id <> b.sample_id),
ranked AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM pairs WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b FROM ranked WHERE r <= 3
""",
    "p6_found": f"""
WITH {_CURRENT},
ranked AS (
  SELECT cluster_id, sample_id, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_distance + 0.0::DOUBLE, sample_id) AS r
  FROM current_rows WHERE cluster_id >= 0 AND NOT isnan(centroid_distance) AND centroid_distance BETWEEN 0 AND 2)
SELECT cluster_id, sample_id FROM ranked WHERE r <= 3
""",
}
