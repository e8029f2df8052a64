"""Spark-native image and video-frame analytics."""
