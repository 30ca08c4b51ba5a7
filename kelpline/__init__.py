"""Spark-native analytics over chat logs, media catalogues and evaluation runs."""
