"""Spark-native graph, overlay, policy and corpus analytics."""
