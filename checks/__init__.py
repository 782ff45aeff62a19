"""Checked queries over the test tables."""

from checks.registry import CHECKS, spark_query
from checks import label_queries, model_queries, report_queries, source_queries, tally_queries, text_queries  # noqa: F401

__all__ = ["CHECKS", "spark_query"]
