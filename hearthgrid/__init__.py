"""Spark-native engine for noisy, multi-source listing data."""
