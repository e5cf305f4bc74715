"""Spark-native signal research over panels of time-ordered series."""
