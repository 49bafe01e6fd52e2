"""Imports the modules that register queries."""

from framewright.plans import q_graphs, q_metrics, q_prep, q_sources, q_spans, q_streams, q_text  # noqa: F401
