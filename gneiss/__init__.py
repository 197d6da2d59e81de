"""Spark-native analytics of where classifiers fail on tabular data."""
