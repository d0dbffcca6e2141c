"""Spark-native stylometry and text-corpus engine."""
