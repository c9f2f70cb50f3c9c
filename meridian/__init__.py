"""Spark-native analytics for large sky catalogues and their light curves."""
