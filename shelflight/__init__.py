"""Spark-native product-affinity analytics: batch build, recommendation, reports, streams."""
