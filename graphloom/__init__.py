"""Spark-native knowledge-graph and code-graph analytics: pure DataFrame operators over memory and code tables."""
