"""Spark-first table and corpus operators."""
