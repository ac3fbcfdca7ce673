"""Spark-native web-content analytics: page capture tables in, ranked and exportable data out."""
