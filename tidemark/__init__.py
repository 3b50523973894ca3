"""Tidemark: point-in-time features, leakage-safe splits, scoring, evaluation and
forecast reports as PySpark DataFrame jobs."""
