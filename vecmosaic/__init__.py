"""Spark-native analytics over feature vectors, small images and their matches."""

__version__ = "0.1.0"
