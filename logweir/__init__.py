"""Spark-native access-log and crawler-traffic analytics."""
