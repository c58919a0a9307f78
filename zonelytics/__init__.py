"""Spark-native analytics for zone-based sensor operations."""
