"""Spark-native analytics over text regions, recognised text and page activity."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
