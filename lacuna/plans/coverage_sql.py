"""SQL of the coverage queries, by name."""

from __future__ import annotations

_CUR = """cur AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM samples WHERE sample_id IS NOT NULL) WHERE rn = 1)"""
_EMB = (
    _CUR
    + """,
usable AS (
  SELECT *, embedding AS e FROM cur WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
emb AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM usable),
dims AS (SELECT unnest(range(1, 65)) AS pos)"""
)


def _mean_of(source: str, key: str, name: str, where: str = "TRUE") -> str:
    """CTEs ``name (key, n, c)``: mean of v per key, at length one."""
    return f"""
{name}_m AS (SELECT {key}, pos, avg(v[pos]) AS m FROM {source}, dims WHERE {where} GROUP BY {key}, pos),
{name}_l AS (SELECT {key}, list(m ORDER BY pos) AS m FROM {name}_m GROUP BY {key}),
{name}_n AS (SELECT {key}, count(*) AS n FROM {source} WHERE {where} GROUP BY {key}),
{name} AS (SELECT l.{key}, k.n, CASE WHEN list_dot_product(m, m) > 0 THEN list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) ELSE m END AS c
  FROM {name}_l l JOIN {name}_n k ON l.{key} = k.{key})"""


_CENT = _EMB + "," + _mean_of("emb", "cluster_id", "cent", "cluster_id >= 0")
_NAMED = """
named AS (SELECT *, lower(trim(ground_truth)) AS child FROM emb WHERE trim(ground_truth) <> '')"""
_LEAVES = "," + _NAMED + "," + _mean_of("named", "child", "leaf")
_ISO = """
iso AS (SELECT a.cluster_id, coalesce(min(greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE - list_dot_product(a.c, b.c)))), 0.0::DOUBLE) AS isolation
  FROM cent a LEFT JOIN cent b ON a.cluster_id <> b.cluster_id GROUP BY a.cluster_id)"""
_LABELS = """
labels AS (SELECT cluster_id, coalesce(nullif(arg_min(coalesce(cluster_label, ''), sample_id), ''), 'Cluster ' || cluster_id) AS label FROM cur WHERE cluster_id >= 0 GROUP BY cluster_id)"""
_TREE = """
tree AS (SELECT trim(parent) AS parent, parent_ord, lower(trim(child)) AS child, child_ord FROM category_hierarchy)"""
_MATCH = """
matched AS (SELECT child, cluster_id, sim_raw FROM (
  SELECT l.child, k.cluster_id, list_dot_product(l.c, k.c) AS sim_raw, row_number() OVER (PARTITION BY l.child ORDER BY list_dot_product(l.c, k.c) DESC, k.cluster_id) AS r
  FROM leaf l JOIN cent k ON TRUE WHERE l.child IN (SELECT child FROM tree)) WHERE r = 1)"""


def _priority(distance: str, expected: str, isolation: str, w: tuple = (0.5, 0.3, 0.2)) -> str:
    clip = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    a, b, c = (f"{float(x)}::DOUBLE" for x in w)
    return f"round((({clip(distance)} * {a} + {expected} * {b} + {clip(isolation)} * {c}) / {float(sum(w))}::DOUBLE) * 100.0::DOUBLE, 2)"


_RECORDS = f"""
records AS (SELECT t.parent, t.parent_ord, t.child, t.child_ord, m.cluster_id AS closest_cluster_id, coalesce(lb.label, 'Cluster ' || m.cluster_id) AS closest_cluster,
    round(m.sim_raw, 4) AS similarity, m.sim_raw < 0.75 AS is_gap, m.sim_raw,
    CASE WHEN m.sim_raw < 0.75 THEN {_priority("1.0::DOUBLE - m.sim_raw", "1.0::DOUBLE", "coalesce(i.isolation, 0.0::DOUBLE)")} END AS priority_score
  FROM tree t JOIN matched m ON t.child = m.child LEFT JOIN iso i ON m.cluster_id = i.cluster_id LEFT JOIN labels lb ON m.cluster_id = lb.cluster_id)"""
_ALL = f"WITH {_CENT}{_LEAVES},{_ISO},{_LABELS},{_TREE},{_MATCH},{_RECORDS}"
_SPARSE = f"""
sparse AS (SELECT s.cluster_id, coalesce(lb.label, 'Cluster ' || s.cluster_id) AS label, s.size AS count,
    {_priority("0.0::DOUBLE", "0.0::DOUBLE", "coalesce(i.isolation, 0.0::DOUBLE)")} AS priority_score
  FROM (SELECT cluster_id, count(*) AS size FROM cur WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) < 3) s LEFT JOIN iso i ON s.cluster_id = i.cluster_id LEFT JOIN labels lb ON s.cluster_id = lb.cluster_id)"""
_SEVERITY = "CASE WHEN priority_score > 70 THEN 'Critical' WHEN priority_score >= 40 THEN 'Moderate' ELSE 'Low' END"
_GAPS = f"""
gaps AS (
  SELECT 'category' AS type, child AS name, priority_score, closest_cluster, NULL::BIGINT AS count, 0 AS type_ord, CAST(parent_ord * 1000000 + child_ord AS BIGINT) AS ord FROM records WHERE is_gap
  UNION ALL SELECT 'sparse_cluster', 'Sparse: ' || label, priority_score, label, count, 1, CAST(cluster_id AS BIGINT) FROM sparse),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, type_ord, ord) AS rank, {_SEVERITY} AS severity FROM gaps)"""
_TARGET = "CASE severity WHEN 'Critical' THEN 8 WHEN 'Moderate' THEN 5 ELSE 3 END"
_POS = "umap_x IS NOT NULL AND umap_y IS NOT NULL AND isfinite(umap_x) AND isfinite(umap_y)"
_DIST = "centroid_distance BETWEEN 0 AND 2 AND NOT isnan(centroid_distance)"
_STATUS = "CASE WHEN cluster_id = -1 THEN 'noise' WHEN size < 3 THEN 'sparse' WHEN size <= 5 THEN 'thin' ELSE 'well-covered' END"
_COLOR = "CASE {0} WHEN 'noise' THEN '#8a8a8a' WHEN 'sparse' THEN '#c62828' WHEN 'thin' THEN '#f9a825' ELSE '#2e7d32' END"
_COVERAGE = """one AS (SELECT round(round(CAST(count(*) FILTER (WHERE NOT is_gap) AS DOUBLE) / count(*), 6), 4) AS coverage_score FROM records)"""
_TOP = "(SELECT * FROM ranked WHERE rank = 1)"
_SAID = """CASE WHEN g.type IS NULL THEN CASE WHEN coverage_pct >= 80 THEN 'Coverage is strong — no urgent collection action required; focus on expanding diversity within existing clusters.'
    ELSE 'Provide an expected_categories list to the operator to surface concrete, actionable gap targets.' END
  WHEN g.type = 'category' THEN 'Prioritize collecting videos that depict ''' || g.name || ''' (nearest existing cluster: ''' || CASE WHEN length(g.closest_cluster) > 50 THEN substr(g.closest_cluster, 1, 49) || '…' ELSE g.closest_cluster END
    || ''') — priority ' || CAST(round_even(g.priority_score, 0) AS INTEGER) || '/100, the most urgent gap.'
  ELSE 'Expand the sparse cluster ''' || CASE WHEN length(g.closest_cluster) > 50 THEN substr(g.closest_cluster, 1, 49) || '…' ELSE g.closest_cluster END || ''' (currently only ' || g.count || ' videos) — priority '
    || CAST(round_even(g.priority_score, 0) AS INTEGER) || '/100, the most isolated underrepresented region.' END"""
_TOTALS = "(SELECT count(*) AS n_samples, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters FROM cur)"
_BREAKDOWN = f"""
stats AS (SELECT cluster_id, count(*) AS size, coalesce(nullif(arg_min(coalesce(cluster_label, ''), sample_id), ''), 'Cluster ' || cluster_id) AS cluster_label,
    arg_min(coalesce(cluster_diversity, ''), sample_id) AS cluster_diversity,
    round(avg(centroid_distance) FILTER (WHERE {_DIST}), 8) AS mean_centroid_distance, round(max(centroid_distance) FILTER (WHERE {_DIST}), 8) AS max_centroid_distance
  FROM cur WHERE cluster_id >= 0 GROUP BY cluster_id)"""
_RUNS = r"""raw AS (
  SELECT dataset_name, "timestamp", coverage_score, n_samples, gaps, delivered_at, regexp_replace(trim("timestamp"), '^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})', '\1-\2-\3T\4:\5:\6') AS t
  FROM coverage_history WHERE gaps IS NOT NULL AND dataset_name IS NOT NULL),
placed AS (
  SELECT *, CAST(substr(replace(t, ' ', 'T'), 1, 19) AS TIMESTAMP) - CASE WHEN regexp_matches(t, '[+-]\d{2}:\d{2}$')
     THEN to_minutes(CAST((CASE WHEN substr(right(t, 6), 1, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(right(t, 6), 2, 2) AS INTEGER) * 60 + CAST(right(t, 2) AS INTEGER)) AS BIGINT))
     ELSE to_minutes(CAST(0 AS BIGINT)) END AS instant FROM raw),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_name, instant ORDER BY delivered_at DESC NULLS LAST) AS d FROM placed) WHERE d = 1),
two AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY instant DESC) AS n FROM runs)"""
_ENTRIES = "entries AS (SELECT entry_id, lower(trim(min(file_hash), ' ')) AS file_hash FROM embedding_batches GROUP BY entry_id)"
_CACHE = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY created_at DESC) AS rn FROM embedding_cache WHERE file_hash IS NOT NULL) WHERE rn = 1),
valid AS (SELECT * FROM latest WHERE len(embedding) = dim)"""

ORACLE = {
    "scan_samples": f"WITH {_CUR} SELECT sample_id, filepath, cluster_id, round(umap_x, 6) + 0.0::DOUBLE AS umap_x, round(umap_y, 6) + 0.0::DOUBLE AS umap_y FROM cur",
    "count_samples": f"WITH {_CUR} SELECT count(*) AS n, count(embedding) AS n_embedded FROM cur",
    "filter_embedded": f"WITH {_CUR} SELECT sample_id, len(embedding) AS dim FROM cur WHERE embedding IS NOT NULL",
    "filter_non_noise": f"WITH {_CUR} SELECT sample_id, cluster_id FROM cur WHERE cluster_id >= 0",
    "filter_embedding_errors": f"WITH {_CUR} SELECT sample_id, embedding_error FROM cur WHERE embedding_error <> ''",
    "filter_tag": f"WITH {_CUR} SELECT sample_id FROM cur WHERE list_contains(tags, 'night')",
    "select_by_ids": f"WITH {_CUR} SELECT sample_id, cluster_id FROM cur WHERE sample_id IN (SELECT sample_id FROM samples WHERE embedding_error <> '')",
    "sort_by_distance": f"WITH {_CUR} SELECT sample_id, round(centroid_distance, 6) + 0.0::DOUBLE AS centroid_distance FROM cur WHERE {_DIST} ORDER BY 2 DESC, 1",
    "group_by_label": f"WITH {_CUR} SELECT cluster_label, count(*) AS n FROM cur GROUP BY 1",
    "extract_cluster_data": f"WITH {_EMB} SELECT sample_id, cluster_id, round(umap_x, 6) + 0.0::DOUBLE AS umap_x, round(umap_y, 6) + 0.0::DOUBLE AS umap_y FROM emb WHERE cluster_id IS NOT NULL AND {_POS}",
    "scatter_points": f"""WITH {_CUR} SELECT round(umap_x, 6) + 0.0::DOUBLE AS umap_x, round(umap_y, 6) + 0.0::DOUBLE AS umap_y, cluster_id, coalesce(is_outlier, FALSE) AS is_outlier,
  regexp_extract(filepath, '[^/]*$') AS file FROM cur WHERE umap_x IS NOT NULL AND umap_y IS NOT NULL AND cluster_id IS NOT NULL""",
    "clear_error_field": f"WITH {_CUR} SELECT sample_id, CASE WHEN embedding_error <> '' THEN '' ELSE embedding_error END AS embedding_error FROM cur",
    "missing_field_audit": f"WITH {_CUR} "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM cur" for c in ("embedding", "cluster_id", "cluster_label", "cluster_confidence", "centroid_distance", "is_outlier", "umap_x", "umap_y")),
    "stratified_sample": f"WITH {_CUR} SELECT sample_id, ground_truth FROM (SELECT sample_id, ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY sample_id) AS n FROM cur WHERE ground_truth IS NOT NULL) WHERE n <= 3",
    "embedding_stats": f"""WITH {_EMB} SELECT count(*) AS n, round(min(list_min(embedding)), 6) AS least, round(max(list_max(embedding)), 6) AS most,
  round(avg(sqrt(list_dot_product(embedding, embedding))), 6) AS mean_norm, max(len(embedding)) AS dim FROM emb""",
    "l2_normalize": f"WITH {_EMB} SELECT sample_id, pos - 1 AS pos, round(v[pos], 6) + 0.0::DOUBLE AS value FROM emb, dims",
    "cosine_distance": """WITH ok AS (SELECT file_hash, created_at, CAST(embedding AS DOUBLE[]) AS e FROM embedding_cache WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ends AS (SELECT file_hash, arg_min(e, created_at) AS a, arg_max(e, created_at) AS b FROM ok GROUP BY 1 HAVING count(DISTINCT created_at) = count(*))
SELECT file_hash, round(greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))), 6) AS distance FROM ends""",
    "pairwise_similarity_stats": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT count(*) AS pairs, round(avg(s), 6) + 0.0::DOUBLE AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most FROM (SELECT list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id)""",
    "core_distances": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)
SELECT vec_id, round(d, 6) + 0.0::DOUBLE AS core_distance FROM (SELECT a.vec_id, 1.0::DOUBLE - list_dot_product(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC) AS r
  FROM u a JOIN u b ON a.vec_id <> b.vec_id) WHERE r = 3""",
    "adaptive_k": f"""WITH {_CUR}, s AS (SELECT count(*) AS n, count(DISTINCT ground_truth) AS n_truth FROM cur WHERE embedding IS NOT NULL)
SELECT n, n_truth, CAST(CASE WHEN n < 4 THEN 1 ELSE greatest(2, least(n_truth, greatest(2, n // 3))) END AS BIGINT) AS k FROM s""",
    "should_retrain": """WITH r AS (SELECT * FROM samples WHERE sample_id IS NOT NULL), m AS (SELECT min(updated_at) + (max(updated_at) - min(updated_at)) / 2 AS m FROM r),
saved AS (SELECT DISTINCT sample_id FROM r, m WHERE updated_at <= m), fresh AS (SELECT DISTINCT sample_id FROM r WHERE sample_id NOT IN (SELECT sample_id FROM saved)),
c AS (SELECT (SELECT count(*) FROM saved) AS n_saved, (SELECT count(*) FROM fresh) AS n_new)
SELECT n_saved, n_new, round(CAST(n_new AS DOUBLE) / n_saved, 6) AS drift, n_saved = 0 OR CAST(n_new AS DOUBLE) / n_saved > 0.3 AS retrain FROM c""",
    "centroids": f"WITH {_CENT} SELECT cluster_id, n, pos - 1 AS pos, round(c[pos], 6) + 0.0::DOUBLE AS value FROM cent, dims",
    "centroid_distance": f"WITH {_CENT} SELECT sample_id, e.cluster_id, round(greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE - list_dot_product(e.v, k.c))), 6) + 0.0::DOUBLE AS distance FROM emb e JOIN cent k ON e.cluster_id = k.cluster_id",
    "kmeans_outliers": f"""WITH {_CENT}, d AS (SELECT sample_id, greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE - list_dot_product(e.v, k.c))) AS distance FROM emb e JOIN cent k ON e.cluster_id = k.cluster_id),
b AS (SELECT avg(distance) AS m, stddev_pop(distance) AS s FROM d) SELECT sample_id, s > 0 AND distance > m + 2.0::DOUBLE * s AS outlier FROM d, b""",
    "nearest_centroid_noise": f"""WITH {_CENT} SELECT sample_id, cluster_id, round(1.0::DOUBLE - s, 6) AS distance FROM (
  SELECT e.sample_id, k.cluster_id, list_dot_product(e.v, k.c) AS s, row_number() OVER (PARTITION BY e.sample_id ORDER BY list_dot_product(e.v, k.c) DESC, k.cluster_id) AS r FROM emb e JOIN cent k ON e.cluster_id = -1) WHERE r = 1""",
    "cluster_sizes": f"WITH {_CUR} SELECT cluster_id, count(*) AS size FROM cur WHERE cluster_id IS NOT NULL GROUP BY 1",
    "sparse_clusters": f"WITH {_CUR} SELECT cluster_id, count(*) AS size FROM cur WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) < 3",
    "cluster_isolation": f"WITH {_CENT},{_ISO} SELECT cluster_id, round(isolation, 6) + 0.0::DOUBLE AS isolation FROM iso",
    "isolated_clusters": f"""WITH {_CENT}, m AS (SELECT a.cluster_id, avg(1.0::DOUBLE - list_dot_product(a.c, b.c)) AS d FROM cent a JOIN cent b ON a.cluster_id <> b.cluster_id GROUP BY 1),
t AS (SELECT avg(d) + 1.5::DOUBLE * stddev_pop(d) AS threshold, count(*) AS k FROM m)
SELECT cluster_id, round(d, 6) + 0.0::DOUBLE AS mean_distance, round(threshold, 6) + 0.0::DOUBLE AS threshold FROM m, t WHERE d > threshold AND k >= 3""",
    "centroid_pairs": f"""WITH {_EMB}{_LEAVES}, d AS (SELECT a.child, greatest(0.0::DOUBLE, least(2.0::DOUBLE, 1.0::DOUBLE - list_dot_product(a.c, b.c))) AS d FROM leaf a JOIN leaf b ON a.child <> b.child)
SELECT child, count(*) AS others, round(avg(d), 6) + 0.0::DOUBLE AS mean_distance, round(min(d), 6) + 0.0::DOUBLE AS least, round(max(d), 6) + 0.0::DOUBLE AS most FROM d GROUP BY 1""",
    "cluster_umap_centers": f"WITH {_EMB} SELECT cluster_id, round(avg(umap_x), 6) + 0.0::DOUBLE AS x, round(avg(umap_y), 6) + 0.0::DOUBLE AS y FROM emb WHERE cluster_id >= 0 AND {_POS} GROUP BY 1",
    "full_breakdown": f"WITH {_CUR},{_BREAKDOWN}, s AS (SELECT *, {_STATUS} AS status FROM stats) SELECT *, {_COLOR.format('status')} AS status_color FROM s",
    "cluster_csv": f"WITH {_CUR},{_BREAKDOWN} SELECT *, {_STATUS} AS status FROM stats",
    "cluster_health": f"WITH {_CUR}, s AS (SELECT cluster_id, count(*) AS size FROM cur WHERE cluster_id IS NOT NULL GROUP BY 1), t AS (SELECT *, {_STATUS} AS status FROM s) SELECT *, {_COLOR.format('status')} AS color FROM t",
    "outlier_count": f"WITH {_CUR} SELECT count(*) FILTER (WHERE cluster_id = -1) AS n_outliers FROM cur",
    "cluster_label_map": f"WITH {_CUR} SELECT cluster_id, coalesce(nullif(arg_min(coalesce(cluster_label, ''), sample_id), ''), 'Cluster ' || cluster_id) AS label FROM cur WHERE cluster_id IS NOT NULL GROUP BY 1",
    "apply_cluster_labels": f"WITH {_CUR},{_LABELS} SELECT sample_id, CASE WHEN c.cluster_id = -1 THEN 'Outliers (HDBSCAN noise)' ELSE coalesce(lb.label, c.cluster_label) END AS new_label FROM cur c LEFT JOIN labels lb ON c.cluster_id = lb.cluster_id",
    "is_generic_label": f"WITH {_CUR} SELECT sample_id, coalesce(cluster_label, '') IN ('', 'Outliers (HDBSCAN noise)') OR coalesce(cluster_label = 'Cluster ' || cluster_id, FALSE) AS generic FROM cur",
    "tag_sparse": f"""WITH {_CUR}, s AS (SELECT cluster_id FROM cur WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) < 3),
t AS (SELECT sample_id, tags, cluster_id IN (SELECT cluster_id FROM s) AND NOT list_contains(coalesce(tags, []), 'sparse_cluster') AS newly FROM cur)
SELECT sample_id, CASE WHEN tags IS NULL AND NOT coalesce(newly, FALSE) THEN NULL ELSE array_to_string(list_sort(CASE WHEN newly THEN list_append(coalesce(tags, []), 'sparse_cluster') ELSE tags END), ',') END AS tags, coalesce(newly, FALSE) AS newly FROM t""",
    "representatives": f"""WITH {_CUR}, r AS (SELECT cluster_id, sample_id, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_distance + 0.0::DOUBLE, sample_id) AS near, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_distance + 0.0::DOUBLE DESC, sample_id) AS far
  FROM cur WHERE cluster_id >= 0 AND {_DIST}) SELECT cluster_id, sample_id, CASE WHEN near <= 2 THEN 'nearest' ELSE 'boundary' END AS role FROM r WHERE near <= 2 OR far <= 1""",
    "representatives_v1": f"WITH {_CUR} SELECT cluster_id, sample_id, rank FROM (SELECT cluster_id, sample_id, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_distance + 0.0::DOUBLE, sample_id) AS rank FROM cur WHERE cluster_id IS NOT NULL AND {_DIST}) WHERE rank <= 2",
    "nearest_rep": f"WITH {_CUR} SELECT cluster_id, sample_id FROM (SELECT cluster_id, sample_id, row_number() OVER (PARTITION BY cluster_id ORDER BY centroid_distance + 0.0::DOUBLE, sample_id) AS rank FROM cur WHERE cluster_id >= 0 AND {_DIST}) WHERE rank = 1",
    "lowest_confidence": f"WITH {_CUR} SELECT sample_id, round(cluster_confidence, 6) + 0.0::DOUBLE AS cluster_confidence FROM cur WHERE cluster_confidence IS NOT NULL ORDER BY cur.cluster_confidence, sample_id LIMIT 5",
    "confidence_summary": f"WITH {_CUR} SELECT cluster_id = -1 AS noise, round(min(cluster_confidence), 6) AS least, round(avg(cluster_confidence), 6) AS mean, round(max(cluster_confidence), 6) AS most FROM cur WHERE cluster_id IS NOT NULL AND cluster_confidence IS NOT NULL GROUP BY 1",
    "silhouette_exact": f"""WITH {_EMB}, own AS (SELECT sample_id, cluster_id, v FROM emb WHERE cluster_id >= 0),
d AS (SELECT a.sample_id, a.cluster_id, b.cluster_id AS other, avg(1.0::DOUBLE - list_dot_product(a.v, b.v)) AS m, count(*) AS n FROM own a JOIN own b ON a.sample_id <> b.sample_id GROUP BY 1, 2, 3),
s AS (SELECT sample_id, cluster_id, max(m) FILTER (WHERE other = cluster_id) AS a, min(m) FILTER (WHERE other <> cluster_id) AS b FROM d GROUP BY 1, 2)
SELECT sample_id, cluster_id, round(CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE (b - a) / greatest(a, b) END, 6) + 0.0::DOUBLE AS silhouette FROM s""",
    "crosstab_truth": f"WITH {_CUR} SELECT cluster_id, coalesce(ground_truth, 'unknown') AS truth, count(*) AS n FROM cur WHERE cluster_id IS NOT NULL GROUP BY 1, 2",
    "adjusted_rand": f"""WITH {_CUR}, c AS (SELECT cluster_id AS a, ground_truth AS b, CAST(count(*) AS DOUBLE) AS n FROM cur WHERE cluster_id IS NOT NULL AND ground_truth IS NOT NULL GROUP BY 1, 2),
i AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS x FROM c), p AS (SELECT sum(s * (s - 1) / 2) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY a)), q AS (SELECT sum(s * (s - 1) / 2) AS x FROM (SELECT sum(n) AS s FROM c GROUP BY b))
SELECT CAST(i.n AS BIGINT) AS n, round((i.x - p.x * q.x / (i.n * (i.n - 1) / 2)) / ((p.x + q.x) / 2 - p.x * q.x / (i.n * (i.n - 1) / 2)), 6) + 0.0::DOUBLE AS ari FROM i, p, q""",
    "parse_hierarchy": """WITH p AS (SELECT parent_ord, min(trim(parent)) AS parent FROM category_hierarchy GROUP BY 1)
SELECT p.parent, CAST(dense_rank() OVER (ORDER BY h.parent_ord) - 1 AS BIGINT) AS parent_ord, trim(child) AS child, row_number() OVER (PARTITION BY h.parent_ord ORDER BY child_ord) - 1 AS child_ord FROM category_hierarchy h JOIN p ON h.parent_ord = p.parent_ord""",
    "unique_leaves": f"WITH {_TREE.strip()} SELECT child, CAST(min(parent_ord * 1000000 + child_ord) AS BIGINT) AS first_ord FROM tree GROUP BY 1",
    "category_match": f"{_ALL} SELECT child, cluster_id, round(sim_raw, 6) AS similarity FROM matched",
    "category_match_samples": f"""WITH {_EMB}{_LEAVES} SELECT child, sample_id, round(s, 6) AS similarity, s < 0.9 AS is_gap FROM (
  SELECT l.child, e.sample_id, list_dot_product(l.c, e.v) AS s, row_number() OVER (PARTITION BY l.child ORDER BY round(list_dot_product(l.c, e.v), 6) DESC, e.sample_id) AS r FROM leaf l JOIN emb e ON TRUE) WHERE r = 1""",
    "gap_priority": f"{_ALL} SELECT parent_ord, child, round(sim_raw, 6) AS similarity, priority_score FROM records WHERE is_gap",
    "gap_priority_weights": f"{_ALL} "
    + " UNION ALL ".join(
        f"SELECT child, {i} AS setting, {_priority('1.0::DOUBLE - sim_raw', '1.0::DOUBLE', 'coalesce(isolation, 0.0::DOUBLE)', w)} AS priority_score FROM matched m LEFT JOIN iso i ON m.cluster_id = i.cluster_id"
        for i, w in enumerate([(0.5, 0.3, 0.2), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.1, 0.8, 0.1)])
    ),
    "category_rollup": f"{_ALL} SELECT parent_ord, parent, count(*) AS n_children, count(*) FILTER (WHERE NOT is_gap) AS n_covered, round(CAST(count(*) FILTER (WHERE NOT is_gap) AS DOUBLE) / count(*), 4) AS coverage, max(similarity) AS best_similarity FROM records GROUP BY 1, 2",
    "category_hierarchy": f"""{_ALL}, r AS (SELECT parent_ord, parent, round(CAST(count(*) FILTER (WHERE NOT is_gap) AS DOUBLE) / count(*), 4) AS coverage FROM records GROUP BY 1, 2)
SELECT x.parent, x.parent_ord, r.coverage, child AS category, similarity, closest_cluster_id, is_gap FROM records x JOIN r ON x.parent_ord = r.parent_ord AND x.parent = r.parent""",
    "category_coverage": f"{_ALL} SELECT count(*) AS n_leaves, count(*) FILTER (WHERE NOT is_gap) AS n_covered, round(CAST(count(*) FILTER (WHERE NOT is_gap) AS DOUBLE) / count(*), 6) AS category_coverage FROM records",
    "category_gaps": f"{_ALL} SELECT child, parent, similarity, priority_score FROM records WHERE is_gap",
    "well_covered": f"{_ALL} SELECT parent, child, similarity, closest_cluster FROM records WHERE NOT is_gap",
    "sparse_clusters_ranked": f"{_ALL},{_SPARSE} SELECT cluster_id, label, count, priority_score FROM sparse",
    "gap_marker_coords": f"""{_ALL}, placed AS (SELECT *, lower(trim(ground_truth)) AS child FROM emb WHERE umap_x IS NOT NULL AND umap_y IS NOT NULL AND NOT isnan(umap_x) AND NOT isnan(umap_y)),
few AS (SELECT child, avg(umap_x) AS x, avg(umap_y) AS y FROM placed WHERE cluster_id = -1 GROUP BY 1), mid AS (SELECT cluster_id, avg(umap_x) AS x, avg(umap_y) AS y FROM placed WHERE cluster_id >= 0 GROUP BY 1)
SELECT r.child, r.parent_ord, round(coalesce(f.x, m.x, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS umap_x, round(coalesce(f.y, m.y, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS umap_y
FROM records r LEFT JOIN few f ON r.child = f.child LEFT JOIN mid m ON r.closest_cluster_id = m.cluster_id WHERE is_gap""",
    "top_gap": f"{_ALL},{_SPARSE},{_GAPS} SELECT type, name, priority_score FROM ranked WHERE rank = 1",
    "priority_gaps": f"""{_ALL},{_SPARSE},{_GAPS}, t AS (SELECT *, CASE WHEN type = 'category' THEN {_TARGET} ELSE greatest({_TARGET}, 5 - coalesce(count, 0)) END AS tg FROM ranked WHERE rank <= 10)
SELECT rank, type, name, priority_score, severity, CAST(tg AS INTEGER) AS target, CASE WHEN type = 'category' THEN 'Collect ~' || tg || ' videos depicting ''' || name || ''' from varied angles, subjects, and settings.'
  ELSE 'Collect ~' || tg || ' more videos similar to ''' || CASE WHEN length(closest_cluster) > 40 THEN substr(closest_cluster, 1, 39) || '…' ELSE closest_cluster END || ''' (currently ' || coalesce(count, 0) || ') to densify the cluster.' END AS advice FROM t""",
    "severity": f"{_ALL},{_SPARSE},{_GAPS} SELECT type, name, ord, severity FROM ranked",
    "executive_totals": f"WITH {_CUR} SELECT count(*) AS n_samples, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS n_clusters FROM cur",
    "executive_summary": f"""{_ALL},{_SPARSE},{_GAPS},{_COVERAGE}, s AS (SELECT coverage_score, round(coverage_score * 100, 1) AS coverage_pct FROM one)
SELECT coverage_score, coverage_pct, CASE WHEN coverage_pct < 30 THEN 'Poor' WHEN coverage_pct < 55 THEN 'Fair' WHEN coverage_pct < 80 THEN 'Good' ELSE 'Excellent' END AS coverage_quality, n_samples, n_clusters,
  (SELECT count(*) FROM gaps WHERE type = 'category') AS n_category_gaps, (SELECT count(*) FROM gaps WHERE type <> 'category') AS n_sparse_clusters, (SELECT count(*) FROM gaps) AS n_gaps_total, {_SAID} AS recommendation
FROM s, {_TOTALS} t LEFT JOIN {_TOP} g ON TRUE""",
    "recommendation": f"{_ALL},{_SPARSE},{_GAPS},{_COVERAGE}, s AS (SELECT coverage_score, round(coverage_score * 100, 1) AS coverage_pct FROM one) SELECT {_SAID} AS recommendation FROM s LEFT JOIN {_TOP} g ON TRUE",
    "history_entry": f"""{_ALL},{_SPARSE},{_GAPS},{_COVERAGE} SELECT '2024-06-01T00:00:00' AS "timestamp", coverage_score, n_samples, CAST(n_clusters AS INTEGER) AS n_clusters, CAST((SELECT count(*) FROM sparse) AS INTEGER) AS n_sparse_clusters, (SELECT count(*) FROM gaps) AS n_gaps FROM one, {_TOTALS} t""",
    "history_previous": f"WITH {_RUNS} SELECT dataset_name, strftime(instant, '%Y-%m-%dT%H:%M:%S') AS previous_at, round(coverage_score, 4) AS coverage_score FROM two WHERE n = 2",
    "coverage_diff": f"""WITH {_RUNS}, names AS (SELECT dataset_name, n, coverage_score, n_samples, list_distinct(list_filter(list_transform(gaps, lambda g: g."name"), lambda x: x IS NOT NULL AND x <> '')) AS names FROM two WHERE n <= 2),
j AS (SELECT c.dataset_name, round(coalesce(c.coverage_score, 0) - coalesce(p.coverage_score, 0), 4) AS d, c.n_samples - p.n_samples AS new_samples, c.names AS a, p.names AS b FROM names c JOIN names p ON c.dataset_name = p.dataset_name AND c.n = 1 AND p.n = 2)
SELECT dataset_name, d AS coverage_delta, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS trend, new_samples,
  array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS closed_gaps, array_to_string(list_sort(list_filter(b, lambda x: list_contains(a, x))), '|') AS still_open_gaps,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS newly_opened_gaps FROM j""",
    "coverage_quality": """WITH p AS (SELECT round(coverage_score * 100, 1) AS p FROM coverage_history WHERE coverage_score IS NOT NULL AND NOT isnan(coverage_score))
SELECT CASE WHEN p < 30 THEN 'Poor' WHEN p < 55 THEN 'Fair' WHEN p < 80 THEN 'Good' ELSE 'Excellent' END AS quality, count(*) AS n FROM p GROUP BY 1""",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 49) || '…' ELSE text END AS short FROM documents",
    "safe_name": r"SELECT doc_id, regexp_replace(coalesce(nullif(author, ''), 'unnamed'), '[^\p{L}\p{N}_-]', '_', 'g') AS dir FROM documents",
    "combine_labels": f"""WITH {_CUR}, l AS (SELECT cluster_id, list_sort(list(DISTINCT ground_truth) FILTER (WHERE ground_truth IS NOT NULL)) AS l FROM cur WHERE cluster_id >= 0 GROUP BY 1)
SELECT cluster_id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:2], '; ') ELSE 'Cluster ' || cluster_id END AS label FROM l""",
    "dedup_variations": f"""WITH {_CUR}, p AS (SELECT sample_id, trim(unnest(string_split(cluster_diversity, ';'))) AS t, generate_subscripts(string_split(cluster_diversity, ';'), 1) AS i FROM cur WHERE cluster_diversity IS NOT NULL),
f AS (SELECT sample_id, lower(t) AS k, arg_min(t, i) AS t, min(i) AS i FROM p WHERE t <> '' GROUP BY 1, 2), j AS (SELECT sample_id, string_agg(t, '; ' ORDER BY i) AS variations FROM f GROUP BY 1)
SELECT c.sample_id, coalesce(j.variations, '') AS variations FROM cur c LEFT JOIN j ON c.sample_id = j.sample_id WHERE c.cluster_diversity IS NOT NULL""",
    "marker_sizes": f"WITH {_CUR}, r AS (SELECT sample_id, centroid_distance AS d FROM cur WHERE cluster_id >= 0 AND {_DIST}), t AS (SELECT greatest(max(d), 0.001::DOUBLE) AS m FROM r) SELECT sample_id, round(6.0::DOUBLE + 8.0::DOUBLE * d / m, 6) AS marker FROM r, t",
    "svg_coords": f"""WITH {_CUR}, r AS (SELECT sample_id, umap_x AS x, umap_y AS y FROM cur WHERE umap_x IS NOT NULL AND umap_y IS NOT NULL AND NOT isnan(umap_x) AND NOT isnan(umap_y)),
t AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r)
SELECT sample_id, round(CASE WHEN x1 > x0 THEN 50 + (x - x0) / (x1 - x0) * 670 ELSE 385.0::DOUBLE END, 6) + 0.0::DOUBLE AS sx, round(CASE WHEN y1 > y0 THEN 20 + (1.0::DOUBLE - (y - y0) / (y1 - y0)) * 452 ELSE 246.0::DOUBLE END, 6) + 0.0::DOUBLE AS sy FROM r, t""",
    "grid_coverage": f"""WITH {_CUR}, p AS (SELECT umap_x AS x, umap_y AS y FROM cur WHERE {_POS}), r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
c AS (SELECT DISTINCT least(9, floor((x - (x0 - (x1 - x0) * 0.01::DOUBLE)) / (((x1 - x0) + 2 * ((x1 - x0) * 0.01::DOUBLE)) / 10))) * 10 + least(9, floor((y - (y0 - (y1 - y0) * 0.01::DOUBLE)) / (((y1 - y0) + 2 * ((y1 - y0) * 0.01::DOUBLE)) / 10))) AS c FROM p, r WHERE x1 > x0 AND y1 > y0)
SELECT count(*) AS cells, round(CAST(count(*) AS DOUBLE) / 100, 6) + 0.0::DOUBLE AS coverage FROM c""",
    "kde_grid": f"""WITH {_CUR}, p AS (SELECT umap_x AS x, umap_y AS y FROM cur WHERE {_POS}),
s AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, var_samp(x) * pow(count(*), -1.0::DOUBLE / 3) AS a, covar_samp(x, y) * pow(count(*), -1.0::DOUBLE / 3) AS b, var_samp(y) * pow(count(*), -1.0::DOUBLE / 3) AS c FROM p),
g AS (SELECT i, j, x0 - 0.1::DOUBLE * (x1 - x0) + i * 1.2::DOUBLE * (x1 - x0) / 79 AS gx, y0 - 0.1::DOUBLE * (y1 - y0) + j * 1.2::DOUBLE * (y1 - y0) / 79 AS gy, n, a, b, c, a * c - b * b AS det
  FROM s, (SELECT unnest(range(80)) AS i), (SELECT unnest(range(80)) AS j))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(exp(-0.5::DOUBLE * (c * (gx - x) * (gx - x) - 2 * b * (gx - x) * (gy - y) + a * (gy - y) * (gy - y)) / det)) / (2 * pi() * sqrt(det) * n), 6) + 0.0::DOUBLE AS density
FROM g, p GROUP BY i, j, det, n""",
    "polygon_area": f"""WITH {_EMB}, r AS (SELECT cluster_id, sample_id, umap_x AS x, umap_y AS y FROM emb WHERE cluster_id >= 0 AND {_POS}),
e AS (SELECT cluster_id, first(x ORDER BY x, sample_id) AS ax, first(y ORDER BY x, sample_id) AS ay, first(x ORDER BY y, sample_id) AS bx, first(y ORDER BY y, sample_id) AS by_,
  first(x ORDER BY x DESC, sample_id DESC) AS cx, first(y ORDER BY x DESC, sample_id DESC) AS cy, first(x ORDER BY y DESC, sample_id DESC) AS dx, first(y ORDER BY y DESC, sample_id DESC) AS dy FROM r GROUP BY 1)
SELECT cluster_id, round(abs((ax * by_ - bx * ay) + (bx * cy - cx * by_) + (cx * dy - dx * cy) + (dx * ay - ax * dy)) / 2, 6) AS area FROM e""",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS file_hash FROM documents",
    "cache_lookup": f"WITH {_ENTRIES}, {_CACHE} SELECT entry_id, c.embedding IS NOT NULL AS hit, round(sqrt(list_dot_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 4) AS norm FROM entries e LEFT JOIN valid c ON e.file_hash = c.file_hash",
    "cache_misses": f"WITH {_ENTRIES}, {_CACHE} SELECT entry_id FROM entries WHERE file_hash IS NULL OR file_hash NOT IN (SELECT file_hash FROM valid)",
    "cache_upsert": "SELECT file_hash, round(max(created_at), 6) + 0.0::DOUBLE AS created_at FROM (SELECT file_hash, created_at FROM embedding_cache UNION ALL SELECT file_hash, created_at FROM embedding_batches) WHERE file_hash IS NOT NULL GROUP BY 1",
    "cache_stats": f"WITH {_CACHE} SELECT count(*) AS entries, CAST(sum(4 * coalesce(len(embedding), 0)) AS BIGINT) AS vector_bytes FROM latest",
    "embed_status": f"WITH {_CUR}, {_CACHE} SELECT sample_id, CASE WHEN s.embedding IS NOT NULL THEN 'already_embedded' WHEN c.embedding IS NOT NULL THEN 'cache_hit' ELSE 'fetch' END AS status FROM cur s LEFT JOIN valid c ON sha256(coalesce(filepath, '')) = c.file_hash",
    "embed_status_counts": f"WITH {_CUR}, {_CACHE} SELECT CASE WHEN s.embedding IS NOT NULL THEN 'already_embedded' WHEN c.embedding IS NOT NULL THEN 'cache_hit' ELSE 'fetch' END AS status, count(*) AS n FROM cur s LEFT JOIN valid c ON sha256(coalesce(filepath, '')) = c.file_hash GROUP BY 1",
    "failure_reasons_top": f"WITH {_CUR} SELECT embedding_error AS reason, count(*) AS n FROM cur WHERE embedding_error <> '' GROUP BY 1 ORDER BY n DESC, reason LIMIT 5",
    "rate_limit_flag": "SELECT embedding_error, count(*) AS n, regexp_matches(lower(embedding_error), '429|rate|too many') AS rate_limited FROM samples WHERE embedding_error IS NOT NULL GROUP BY 1",
    "timing_summary": """WITH g AS (SELECT dataset_name, count(*) AS n, epoch_us(max(delivered_at)) - epoch_us(min(delivered_at)) AS us FROM coverage_history WHERE dataset_name IS NOT NULL AND delivered_at IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT CAST(us AS DOUBLE) / 1e6::DOUBLE / (n - 1) AS s FROM g) SELECT round(sum(s), 3) AS total, round(avg(s), 3) AS mean, round(min(s), 3) AS least, round(max(s), 3) AS most, round(avg(s) * 100, 3) AS for_100 FROM p""",
}
