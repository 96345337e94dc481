"""Spark-native product analytics: DataFrame and SQL operators compiled from small specs."""
