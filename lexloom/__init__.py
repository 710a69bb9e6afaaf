"""Spark-native analytics over annotated linguistic corpora."""
