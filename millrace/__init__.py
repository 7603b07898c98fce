"""Declarative data pipelines on Spark: sources, row transformations, routed sinks and reports."""
