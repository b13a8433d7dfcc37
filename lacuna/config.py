"""Parameters of an analysis run and the fixed constants of its rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds, weights and labels of the coverage rules.
SPARSE_THRESHOLD = 3
THIN_MAX = 5
GAP_SIMILARITY = 0.30
GAP_SIMILARITY_V1 = 0.10
ISOLATION_STD_FACTOR = 1.5
OUTLIER_STD_FACTOR = 2.0
VORONOI_FACTOR = 1.5
KDE_GRID = 80
COVERAGE_GRID = 10
PRIORITY_WEIGHTS = (0.5, 0.3, 0.2)
COVERAGE_BANDS = ((30.0, "Poor"), (55.0, "Fair"), (80.0, "Good"))
COVERAGE_TOP = "Excellent"
SEVERITY_CRITICAL_ABOVE = 70.0
SEVERITY_MODERATE_FROM = 40.0
TARGETS = {"Critical": 8, "Moderate": 5, "Low": 3}
MAX_PRIORITY_GAPS = 10
NOISE = -1
NOISE_LABEL = "Outliers (HDBSCAN noise)"
SPARSE_TAG = "sparse_cluster"
MIN_CLUSTER_SIZE = 3
KMEANS_RUNS, SEED = 10, 42
RETRAIN_DRIFT = 0.30
HASH_BYTES = 10 * 1024 * 1024
RETRIES, FIRST_BACKOFF = 3, 2.0
HEALTH_COLOURS = {"well-covered": "#2e7d32", "thin": "#f9a825", "sparse": "#c62828", "noise": "#8a8a8a"}
HEALTH_DOTS = {"well-covered": "🟢", "thin": "🟡", "sparse": "🔴", "noise": "⚫"}
# Sentences of the reports.
STRONG_COVERAGE = "Coverage is strong — no urgent collection action required; focus on expanding diversity within existing clusters."
NO_CATEGORIES = "Provide an expected_categories list to the operator to surface concrete, actionable gap targets."
PRIORITISE = "Prioritize collecting videos that depict '%s'%s — priority %d/100, the most urgent gap."
NEAREST = " (nearest existing cluster: '%s')"
EXPAND = "Expand the sparse cluster '%s' (currently only %d videos) — priority %d/100, the most isolated underrepresented region."
COLLECT_CATEGORY = "Collect ~%d videos depicting '%s' from varied angles, subjects, and settings."
COLLECT_CLUSTER = "Collect ~%d more videos similar to '%s' (currently %d) to densify the cluster."


@dataclass
class AnalysisConfig:
    """What a run can be asked for."""

    expected_categories: str = ""
    n_clusters: int = 0  # 0: density clustering
    max_samples: int = 0  # 0: all
    gap_threshold: float = GAP_SIMILARITY
    describe: bool = False
    preserve_labels: bool = False
    clear_cache: bool = False
    dim: int = 64
    weights: tuple[float, float, float] = field(default=PRIORITY_WEIGHTS)
