"""Spark-native analytics for financial time series; see README.md."""
