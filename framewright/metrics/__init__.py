"""Grounding, detection, classification and retrieval metrics."""
