"""Spark-native recovery of deleted data from copy-on-write filesystem images."""
