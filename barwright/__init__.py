"""Spark-native evidence engine for time-ordered observations."""
