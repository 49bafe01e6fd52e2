"""Scene-graph, grounding-metric and dataset-preparation analytics on Spark DataFrames."""

from framewright.session import ship_code

ship_code(__name__)
