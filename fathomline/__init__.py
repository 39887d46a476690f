"""Catalogue analytics as Spark DataFrame and SQL functions."""
