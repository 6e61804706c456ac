"""Spark-native security analytics over source files, configuration and text."""
