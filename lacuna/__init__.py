"""lacuna: coverage-gap analytics for embedded datasets, on Spark DataFrames."""

from lacuna.config import AnalysisConfig
from lacuna.plans.api import analyze, append_history, describe_cluster, export_report, last_diff, panel_payload, show_report

__version__ = "0.2.0"
__all__ = ["AnalysisConfig", "analyze", "append_history", "describe_cluster", "export_report", "last_diff", "panel_payload", "show_report"]
