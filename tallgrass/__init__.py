"""Spark-native analytics over conversations, event logs, documents and web pages."""
