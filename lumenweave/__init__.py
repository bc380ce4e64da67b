"""Spark-native analytics over raw frames, codec reports and text corpora."""
