"""Spark-native analytics over textual engineering evidence."""
