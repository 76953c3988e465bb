"""Spark-native analytics over detections, tiles, tracks and trade-off tables."""
