"""Structural and temporal ranking of code bases on Spark: symbols, references, paths and commits as tables."""
