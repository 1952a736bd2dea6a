"""Spark-native engine for building and evaluating sentence-aligned parallel corpora."""
