"""Spark-native engine for building, deduplicating and auditing text and decision datasets."""
