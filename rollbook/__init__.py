"""Rollbook: Spark-native analytics over manifested document corpora."""
