"""Spark-native analytics for dispersed, short-duration signals in time-frequency data."""
