"""Spark-native processing of engineering-drawing records, with a separate subpackage for text corpora."""
