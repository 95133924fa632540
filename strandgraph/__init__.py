"""Spark-native property-graph analytics over source-code graphs."""

from .graph import Graph

__all__ = ["Graph"]
