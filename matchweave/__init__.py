"""Spark-native matching and engagement analytics."""
