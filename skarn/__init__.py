"""Spark-native change-intelligence analytics."""
