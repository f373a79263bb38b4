"""Spark-native engine for operational event data and training-corpus preparation."""
