"""Spark-native analytics over packed archives and the blobs inside them."""
