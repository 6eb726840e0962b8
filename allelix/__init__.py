"""Spark-first genomic variant analytics: operators, sources, functions and plans."""
