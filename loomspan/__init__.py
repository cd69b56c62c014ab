"""Structural queries over text and symbol graphs, on Spark."""
