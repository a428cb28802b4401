"""Spark-native engine for auditing corpora of manuscripts."""
